"""Point-in-time feature families over a customer panel."""
