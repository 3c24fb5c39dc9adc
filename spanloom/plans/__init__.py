from spanloom.plans import queries, clips, pictures, records, rules, selection  # noqa: F401  # each registers its queries or their SQL
