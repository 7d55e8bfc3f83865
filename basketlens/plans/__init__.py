"""Named query plans (catalog), their SQL oracles and the report bundle."""
