"""Queries over names and numbers of persons: texts with known spans made of customers, spans found, texts masked."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import names as N
from sedimenta.plans.registry import query
from sedimenta.session import settle, table

# Sentences with places for spans (upper case) and for other words (lower case).
SENTENCES = """
{PERSON} submitted the {adj} report.|Contact {PERSON} at {EMAIL_ADDRESS} for details.|Contact me at {EMAIL_ADDRESS} for details.|Send to {EMAIL_ADDRESS} please.|Call {PHONE_NUMBER} now.
Reach us at {PHONE_NUMBER}.|International: {PHONE_NUMBER}.|Email {EMAIL_ADDRESS}, call {PHONE_NUMBER}, SSN {US_SSN}.|SSN is {US_SSN}.|Her social security number {US_SSN} was filed by {PERSON}.
Card: {CREDIT_CARD}.|Please charge the card {CREDIT_CARD} today.|Transfer to {IBAN_CODE}.|IBAN {IBAN_CODE} belongs to {PERSON}.|Wire it to account {US_BANK_NUMBER} at the bank.|Deposit into account number {US_BANK_NUMBER}, {PERSON} said.
{PERSON} and {PERSON} met on {month} {n}.|We asked {PERSON}, who lives in {place}.|Email {EMAIL_ADDRESS} and {EMAIL_ADDRESS}.|My name is {PERSON}.|According to {PERSON}, revenue grew in {year}.
{firm} reported {adj} earnings.|What was {firm} revenue in Q{q} {year}?|Revenue grew in {year}.|Results for Q{q} {year}.|The {term} plan of {firm} rose {n} percent.|A {term} account holds {amount} dollars.
Shares of {firm} fell on the {term} in {month} {year}.|Total assets were {amount} in {year}.|{place} is a large market.|Order {digits} was shipped to {place}.|Net income was {amount} and cash {amount}.|See note {n} of the {year} filing.|The {adj} part {digits} costs {amount}.
{firm} has an office at {street}.|The {adj} store is at {street}, {place}.|{PERSON} moved to {street} in {year}.|Send the {adj} report to {firm}.|Call the office now.|Contact us at {firm} for details.|Please charge it today.|Wire {amount} to {firm} at the bank.|We met in {place} on {month} {n}.
""".strip().replace("\n", "|").split("|")
# Other words.
WORDS = {
    "adj": "quarterly annual final small strong new second".split(),
    "firm": ["Apple Inc.", "Acme Corp", "Global Widgets Ltd", "Morgan Stanley", "Northern Steel", "Blue Bolt Company", "General Motors", "First Union Bank", "Tesla"],
    "place": ["Boston", "New York", "California", "San Francisco", "Texas", "Germany", "United Kingdom", "Lake County"],
    "month": "January February March April May June July August September October November December".split(),
    "term": ["Roth IRA", "NASDAQ", "FDIC", "SEC", "Dow", "GAAP", "COBRA", "ETF"],
}
SYLLABLES = "ba do ka li mo na ra su ti vo ze fen mar lin gor sel tam wick ber nard".split()


def _name(r: random.Random, known: list[str]) -> str:
    """A known name, or one made up of syllables."""
    return (r.choice(known) if r.random() < 0.5 else "".join(r.choice(SYLLABLES) for _ in range(r.randint(2, 3)))).capitalize()


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def slot(kind: str, r: random.Random) -> str:
    """What stands in a place of a sentence."""
    d = lambda n: _digits(r, n)
    if kind in WORDS:
        return r.choice(WORDS[kind])
    if kind == "PERSON":
        middle = f" {r.choice('ABCDEJKLMR')}." if r.random() < 0.15 else ""
        return f"{_name(r, N.GIVEN)}{middle} {_name(r, N.FAMILY)}"
    if kind == "EMAIL_ADDRESS":
        user = r.choice(["{}.{}", "{}", "{}_{}", "{}{}"]).format(_name(r, N.GIVEN).lower(), r.choice([_name(r, N.FAMILY).lower(), d(2)]))
        return f"{user}@{r.choice(['example', 'test', 'corp', 'mail-' + _name(r, N.FAMILY).lower()])}.{r.choice(['com', 'org', 'io', 'co.uk'])}"
    if kind == "PHONE_NUMBER":
        return r.choice(["({}) {}-{}", "{}.{}.{}", "+1-{}-{}-{}", "{}-{}-{}", "+1 {} {} {}"]).format(d(3), d(3), d(4))
    if kind == "US_SSN":
        return r.choice(["{}-{}-{}", "{} {} {}"]).format(d(3), d(2), d(4))
    if kind == "CREDIT_CARD":
        return r.choice([" ", "-", ""]).join(d(4) for _ in range(4))
    if kind == "US_BANK_NUMBER":
        return d(r.randint(8, 14))
    if kind == "IBAN_CODE":
        return r.choice(["GB", "DE", "FR", "NL"]) + d(2) + "".join(r.choice("ABCDEFGHKLMNW") for _ in range(r.choice([0, 4]))) + d(r.randint(12, 16))
    if kind == "street":
        return f"{r.randint(1, 2000)} {r.choice(['', '', 'North ', 'West '])}{r.choice([_name(r, N.FAMILY), 'Oak', 'Main', 'Lake', 'Second', 'Park'])} {r.choice(['Street', 'Avenue', 'Road', 'Lane', 'Drive', 'Blvd', 'St', 'Ave'])}"
    return {"year": str(r.randint(1995, 2030)), "n": str(r.randint(1, 31)), "q": str(r.randint(1, 4)), "digits": d(r.randint(5, 7)), "amount": f"{r.randint(1, 999)},{d(3)}.{d(2)}"}[kind]


def noise(r: random.Random) -> str:
    """Words without meaning, with capitals, signs and numbers of any kind between them."""
    mood, out = r.random(), ""
    for n in range(r.randint(2, 14)):
        word = "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))
        word = word.upper() if mood < 0.1 else word.capitalize() if n == 0 or r.random() < 0.08 else word
        if r.random() < 0.08:
            word = r.choice([".".join(_digits(r, r.randint(1, 3)) for _ in range(4)), _digits(r, r.randint(1, 5)), f"{_digits(r, 2)}:{_digits(r, 2)}", f"{_digits(r, 4)}-{_digits(r, 2)}-{_digits(r, 2)}"])
        out += (r.choice([" ", " ", " ", " ", ", ", "$$$ ", "*** ", "%%% ", "### ", "!! ", "&&& ", " | ", "; "]) if n else "") + word
    return out + r.choice([".", ".", "!", "?", "", " |"])


def sentence(r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A text of one to three sentences, and its spans."""
    text, spans = "", []
    for n in range(r.randint(1, 3)):
        text += " " if n else ""
        if r.random() < 0.25:
            text += noise(r)
            continue
        for piece in r.choice(SENTENCES).replace("}", "{").split("{"):
            kind = piece in N.MASKS or piece in WORDS or piece in ("street", "year", "n", "q", "digits", "amount")
            said = slot(piece, r) if kind else piece
            if piece in N.MASKS:
                spans.append((len(text), len(text) + len(said), piece))
            text += said
    return text, spans


#: Customers whose texts one task makes, if the session asks for fewer tasks.
DEALT = 10_000
LETTER = "id long, text string, spans array<struct<start:int,end:int,type:string>>"


def letters(spark: SparkSession, sf: str) -> DataFrame:
    """A text of each customer with the spans it was made with: ``id``, ``text``, ``spans``.

    Keys are a few bytes of a table, so a file of them is one task however many
    they are; they are dealt out before texts are made, and texts are written once for all that reads them.
    """
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *sentence(random.Random(int(i) * 7919 + 17))) for i in pdf["id"]]
            yield pd.DataFrame([(i, t, [{"start": a, "end": z, "type": k} for a, z, k in s]) for i, t, s in rows], columns=["id", "text", "spans"])

    keys = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // DEALT))
    return settle(keys.repartition(tasks, "id").mapInPandas(made, LETTER), "letters")


def model(made: DataFrame) -> N.Model:
    """Learned from the texts (``letters``) of customers whose key 5 does not divide."""
    return N.fit(made.where("id % 5 <> 0"))


@query()
def name_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans found in the text of each customer, and whether it was held out."""
    made = letters(spark, sf)
    m = model(made)
    d = made.select("id", "text")
    d = d.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-d.count() // DEALT)), "id")
    s = N.with_spans(d, m).select("id", F.explode("spans").alias("s"))
    return s.select("id", (F.col("id") % 5 == 0).alias("held_out"), "s.start", "s.end", "s.type", F.round("s.score", 4).alias("score"))


@query()
def masked_persons(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts of all conversations, with what the tagger and the supplemental rules find replaced."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return N.masked(c, model(letters(spark, sf))).select("conv_id", "turn", F.md5("masked").alias("masked_md5"), F.size("spans").alias("n_spans"))
