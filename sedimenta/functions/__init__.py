"""sedimenta.functions"""
