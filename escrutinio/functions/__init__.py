"""Column expressions: rates, money rules, text, identity, handles, time and checks."""
