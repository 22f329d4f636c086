"""sedimenta.streaming"""
