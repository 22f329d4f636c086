"""sedimenta.operators"""
