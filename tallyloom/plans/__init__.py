"""tallyloom.plans: registered queries over the test tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations


def catalog() -> tuple[dict, dict[str, str]]:
    """(queries, oracle SQL) of all plan modules."""
    from tallyloom.plans import cases, models, more, sets, sweeps, vectors, words

    queries, sql = {}, {}
    for module in (words, sets, models, sweeps, cases, more, vectors):
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
