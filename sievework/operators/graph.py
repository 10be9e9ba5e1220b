"""Nodes and edges of the groups' drawings, and a plain page for each group."""

from __future__ import annotations

import html
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nodes(members: DataFrame, posts: DataFrame, shared: DataFrame) -> DataFrame:
    """(kind, name, group_account): accounts, their posts, and what they share."""
    accounts = members.select(F.lit("account").alias("kind"), F.col("account").alias("name"), "group_account")
    own = posts.join(members, "account").select(F.lit("post").alias("kind"), F.col("post_id").alias("name"), "group_account")
    things = shared.select("kind", F.col("value").alias("name"), "group_account").distinct()
    return accounts.unionByName(own).unionByName(things)


def edges(members: DataFrame, posts: DataFrame, shared: DataFrame) -> DataFrame:
    """(relation, source, target, group_account): who wrote what and who shares what."""
    wrote = posts.join(members, "account").select(F.lit("wrote").alias("relation"), F.col("account").alias("source"), F.col("post_id").alias("target"), "group_account")
    shares = shared.select(F.lit("shares").alias("relation"), F.col("account").alias("source"), F.col("value").alias("target"), "group_account").distinct()
    return wrote.unionByName(shares)


def page(title: str, names: list[tuple[str, str]], lines: list[tuple[str, str, str]]) -> str:
    """One self-contained page: nodes in three columns (posts, accounts, things), edges as arcs."""
    column = {"post": 0, "account": 1}
    place: dict[str, tuple[int, int]] = {}
    filled = [0, 0, 0]
    shapes = []
    for kind, name in sorted(names):
        c = column.get(kind, 2)
        x, y = 40 + 320 * c, 40 + 28 * filled[c]
        filled[c] += 1
        place[name] = (x, y)
        shapes.append(f'<circle cx="{x}" cy="{y}" r="5" class="k{c}"/><text x="{x + 9}" y="{y + 4}">{html.escape(name)}</text>')
    arcs = []
    for relation, a, b in sorted(lines):
        if a in place and b in place:
            (x1, y1), (x2, y2) = place[a], place[b]
            arcs.append(f'<path d="M{x1} {y1} Q{(x1 + x2) // 2} {min(y1, y2) - 12} {x2} {y2}" class="{html.escape(relation)}"/>')
    size = 80 + 28 * max(filled)
    style = "text{font:12px sans-serif}path{fill:none;stroke:#999}.k0{fill:#777}.k1{fill:#246}.k2{fill:#a42}"
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style><h1>{html.escape(title)}</h1><svg xmlns="http://www.w3.org/2000/svg" width="1000" height="{size}">{"".join(arcs)}{"".join(shapes)}</svg>\n'


#: Nodes and edges up to which a group is drawn; a larger one gets a page with its counts.
MOST_NODES, MOST_EDGES = 2_000, 20_000


def pages(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(group_account, html): a page for every group, drawn up to ``MOST_NODES`` nodes and ``MOST_EDGES`` edges, else with counts by kind.

    A group without edges is drawn by its nodes; null group names have no page.
    """
    tally = lambda df, kind: df.where("group_account IS NOT NULL").groupBy("group_account", kind).agg(F.count("*").alias("n"))
    counts = tally(node_rows, "kind").groupBy("group_account").agg(F.sum("n").alias("nodes"), F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("kinds"))
    lines = tally(edge_rows, "relation").groupBy("group_account").agg(F.sum("n").alias("edges"), F.array_sort(F.collect_list(F.struct(F.col("relation").alias("kind"), "n"))).alias("relations"))
    size = counts.join(lines, "group_account", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    small = size.where((F.col("nodes") <= MOST_NODES) & (F.col("edges") <= MOST_EDGES)).select("group_account")
    own = node_rows.join(small, "group_account").groupBy("group_account").agg(F.collect_list(F.struct("kind", "name")).alias("names"))
    drawn = edge_rows.join(small, "group_account").groupBy("group_account").agg(F.collect_list(F.struct("relation", "source", "target")).alias("lines"))

    def draw(title: pd.Series, names: pd.Series, lines: pd.Series) -> pd.Series:
        rows = lambda x, keys: [tuple(r[k] for k in keys) for r in x] if x is not None else []
        return pd.Series([page(t, rows(n, ("kind", "name")), rows(e, ("relation", "source", "target"))) for t, n, e in zip(title, names, lines)], dtype=object)

    def count(title: pd.Series, kinds: pd.Series, relations: pd.Series) -> pd.Series:
        items = lambda *lists: "".join(f"<li>{html.escape(str(r['kind']))}: {r['n']}</li>" for x in lists if x is not None for r in x)
        return pd.Series([f'<!doctype html><meta charset="utf-8"><title>{html.escape(t)}</title><h1>{html.escape(t)}</h1><p>Too large to draw.</p><ul>{items(k, r)}</ul>\n' for t, k, r in zip(title, kinds, relations)], dtype=object)

    near = own.join(drawn, "group_account", "left").select("group_account", F.pandas_udf(draw, "string")("group_account", "names", "lines").alias("html"))
    far = size.join(small, "group_account", "left_anti").select("group_account", F.pandas_udf(count, "string")("group_account", "kinds", "relations").alias("html"))
    return near.unionByName(far)


def write_pages(node_rows: DataFrame, edge_rows: DataFrame, folder: str) -> list[str]:
    """The pages of all groups as files of a folder that all executors share, written there by the tasks; pages of groups that are gone are removed.

    A file is named by the group, other characters than letters, digits, - and _ by their code points.
    """
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    made = pages(node_rows, edge_rows)

    def save(rows):
        for r in rows:
            (at / file_name(r.group_account)).write_text(r.html, encoding="utf-8", newline="\n")

    made.foreachPartition(save)
    present = {p.name for p in at.glob("*.html")}
    names = node_rows.where("group_account IS NOT NULL").select("group_account").distinct().toLocalIterator()
    written = sorted({file_name(r.group_account) for r in names})
    for old in present.difference(written):
        (at / old).unlink()
    return [str(at / n) for n in written]


def file_name(group: str) -> str:
    return "".join(ch if ch.isalnum() or ch in "-_" else f"+{ord(ch):x}+" for ch in group) + ".html"
