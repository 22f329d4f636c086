"""sedimenta.sources"""
