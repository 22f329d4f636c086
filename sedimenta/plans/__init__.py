"""sedimenta.plans"""
