def collected(df):
    """Rows as tuples in one order."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
