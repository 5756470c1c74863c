from __future__ import annotations


def rows(df, *names):
    """Result rows as sorted tuples."""
    picked = df.select(*names) if names else df
    return sorted((tuple(row) for row in picked.collect()), key=repr)


def one(df, expression):
    """The value of a column expression over a one-row frame."""
    return df.select(expression.alias("value")).first().value


def plan_text(df):
    return df._jdf.queryExecution().toString()


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()
