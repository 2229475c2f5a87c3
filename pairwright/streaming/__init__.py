"""No streaming operators: ranks, null laws and posteriors need complete matrices."""
