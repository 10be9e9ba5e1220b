"""Contact points in text and links: addresses and handles, plain or written out."""

from __future__ import annotations

import re
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH = "kind:string,value:string,found_as:string,field:string"
UNREAD = "found_as:string,field:string,reason:string"
_RESULT = f"matches array<struct<{MATCH}>>, unread array<struct<{UNREAD}>>"

# Digits read as letters in a handle, hosts and path segments of handle links, length limits.
SUBSTITUTION = str.maketrans("0134578", "oieastb")
HANDLE_HOSTS = ("t.me", "telegram.me")
INVITES = ("joinchat", "share")
MAX_ADDRESS, MIN_HANDLE, MAX_HANDLE = 254, 5, 32

_LEFT = re.compile(r"[A-Za-z0-9_%+.\- ]*\Z")
_LEFT_PLAIN = re.compile(r"[A-Za-z0-9_%+.\-]*\Z")
_RIGHT = re.compile(r"[A-Za-z0-9_.\- ]*")
_RIGHT_PLAIN = re.compile(r"[A-Za-z0-9_.\-]*")
# series of tokens of one character each, next to the @
_SINGLES_RIGHT = re.compile(r"(?:[^A-Za-z0-9_]*[A-Za-z0-9_](?![A-Za-z0-9_]))+")
_SINGLES_LEFT = re.compile(r"(?:(?<![A-Za-z0-9_])[A-Za-z0-9_](?![A-Za-z0-9_])[^A-Za-z0-9_]*)+\Z")
_LABEL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\Z")
_HANDLE = re.compile(r"[A-Za-z][A-Za-z0-9_]*\Z")


def _tail(pattern: re.Pattern[str], text: str) -> str:
    """The match that ends with the text, looked for from the first place where a run can begin."""
    a = len(text)
    while a and pattern.match(text[a - 1]):
        a -= 1
    return text[a:]


def runs(text: str):
    """(found_as, obfuscated, prose) for every @: the text between two @ holds one's right and the next one's left run."""
    parts = text.split("@")
    for before, after in zip(parts, parts[1:]):
        left, right = _tail(_LEFT, before), _RIGHT.match(after).group()
        plain_left, plain_right = _tail(_LEFT_PLAIN, before), _RIGHT_PLAIN.match(after).group()
        single_left = m.group() if (m := _SINGLES_LEFT.search(left)) else ""
        single_right = m.group() if (m := _SINGLES_RIGHT.match(right)) else ""
        out = bool(single_left or single_right)
        yield f"{single_left or plain_left}@{single_right or plain_right}", out, not out and not plain_left and not plain_right and bool(right)


def read_address(text: str) -> tuple[str | None, str | None]:
    """(address, None) or (None, reason)."""
    whole = "".join(text.split())
    local, _, host = whole.partition("@")
    labels = host.split(".")
    if len(labels) < 2 or not all(_LABEL.match(x) for x in labels):
        return None, "no_domain"
    if len(whole) > MAX_ADDRESS:
        return None, "address_too_long"
    return f"{local}@{host.lower()}", None


def read_handle(name: str, written_out: bool = False) -> tuple[str | None, str | None]:
    """(handle, None) or (None, reason)."""
    name = name.translate(SUBSTITUTION)
    if written_out:
        name = re.sub(r"[^A-Za-z0-9_]", "", name)
    for fault, reason in ((not name, "no_name"), (len(name) < MIN_HANDLE, "handle_too_short"), (len(name) > MAX_HANDLE, "handle_too_long"), (not _HANDLE.match(name), "handle_character")):
        if fault:
            return None, reason
    return name.lower(), None


def scan_text(text: str | None, field: str, matches: list, unread: list) -> None:
    for found_as, out, prose in runs(text or ""):
        kind, (value, reason) = "prose", (None, "prose")
        if not prose:
            trimmed = found_as.rstrip(".- ")
            handle = trimmed.startswith("@")
            kind = "telegram" if handle else "email"
            value, reason = read_handle(trimmed[1:], out) if handle else read_address(trimmed)
        _note(kind, value, reason, found_as, field, matches, unread)


def _note(kind, value, reason, found_as, field, matches, unread) -> None:
    if value is None:
        unread.append({"found_as": found_as, "field": field, "reason": reason})
    else:
        matches.append({"kind": kind, "value": value, "found_as": found_as, "field": field})


def scan_link(link: str, matches: list, unread: list) -> None:
    try:
        parts = urlparse(link)
        host = parts.hostname
    except ValueError:
        _note("", None, "malformed", link, "link", matches, unread)
        return
    if parts.scheme == "mailto":
        _note("email", *read_address(parts.path.strip()), link, "link", matches, unread)
    elif host is not None and host.lower() in HANDLE_HOSTS:
        first = next((x for x in parts.path.split("/") if x), None)
        invite = first is None or first.startswith("+") or first in INVITES
        _note("telegram", *((None, "invite_link") if invite else read_handle(first)), link, "link", matches, unread)


def scan_post(title, body, links) -> dict:
    matches: list = []
    unread: list = []
    scan_text(title, "title", matches, unread)
    scan_text(body, "body", matches, unread)
    for link in links if links is not None else ():
        if link is not None:
            scan_link(link, matches, unread)
    return {"matches": matches, "unread": unread}


def _scan_each(title: pd.Series, body: pd.Series, links: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([scan_post(*row) for row in zip(title, body, links)], columns=["matches", "unread"])


def contact_scan(title: Column | str, body: Column | str, links: Column | str) -> Column:
    """struct(matches, unread) of a post."""
    return F.pandas_udf(_scan_each, _RESULT)(title, body, links)


def extract(posts: DataFrame) -> DataFrame:
    """(post_id, account, contact_points, matches, unread) of every post.

    Only posts with an @ in their text or a link that can name a contact, that urlparse may
    refuse (brackets, other scripts) or cleans (tabs, line breaks) go through Python; null texts and lists
    count as empty.
    """
    link = F.exists(F.coalesce("links", F.array().cast("array<string>")), lambda x: x.rlike(r"(?i)mailto:|t\.me|telegram\.me|[\[\]\t\r\n]|[^\x00-\x7F]"))
    needs = F.coalesce(F.contains("title", F.lit("@")), F.lit(False)) | F.coalesce(F.contains("body", F.lit("@")), F.lit(False)) | F.coalesce(link, F.lit(False))
    one = posts.dropDuplicates(["post_id"])
    empty = F.struct(F.array().cast(f"array<struct<{MATCH}>>").alias("matches"), F.array().cast(f"array<struct<{UNREAD}>>").alias("unread"))
    scanned = one.where(needs).select("post_id", "account", contact_scan("title", "body", "links").alias("x"))
    plain = one.where(~needs).select("post_id", "account", empty.alias("x"))
    points = F.array_sort(F.array_distinct(F.transform("x.matches", lambda m: m["value"])))
    return scanned.unionByName(plain).select("post_id", "account", points.alias("contact_points"), "x.matches", "x.unread")


def reach_counts(contacts: DataFrame) -> DataFrame:
    """(kind, value, accounts, posts, spellings): how many published each contact point, and how it was written.

    Only spellings are gathered; accounts and posts of a hot point are counted, never brought together.
    """
    each = contacts.select("post_id", "account", F.explode("matches").alias("m")).select("post_id", "account", "m.kind", "m.value", "m.found_as")
    keys = ["kind", "value"]
    count = lambda c, n: each.select(*keys, c).distinct().groupBy(*keys).agg(F.count(c).alias(n))
    written = each.select(*keys, "found_as").distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("found_as")).alias("spellings"))
    return count("account", "accounts").join(count("post_id", "posts"), keys).join(written, keys).select(*keys, "accounts", "posts", "spellings")


def reach(contacts: DataFrame) -> DataFrame:
    """(kind, value, accounts, posts, spellings, shared): who published each contact point; shared means two accounts or more.

    The lists of a hot point are as long as its users are many; ``reach_counts`` doesn't gather them.
    """
    each = contacts.select("post_id", "account", F.explode("matches").alias("m"))
    sets = each.groupBy(F.col("m.kind").alias("kind"), F.col("m.value").alias("value")).agg(
        *(F.array_sort(F.collect_set(c)).alias(n) for c, n in (("account", "accounts"), ("post_id", "posts"), ("m.found_as", "spellings")))
    )
    return sets.withColumn("shared", F.size("accounts") > 1)


def recall(published: DataFrame, found: DataFrame) -> DataFrame:
    """(found, missed, stray, invented): published points read or not, and read ones that weren't published.

    Both inputs hold distinct (post_id, value).  A point that was read though the post publishes
    others is stray; in a post that publishes none it is invented.
    """
    both = published.withColumn("p", F.lit(True)).join(found.withColumn("f", F.lit(True)), ["post_id", "value"], "full")
    some = published.select("post_id").distinct().withColumn("some", F.lit(True))
    rows = both.join(some, "post_id", "left")
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("bigint")), F.lit(0))
    p, f, s = F.col("p").isNotNull(), F.col("f").isNotNull(), F.col("some").isNotNull()
    return rows.agg(n(p & f).alias("found"), n(p & ~f).alias("missed"), n(~p & f & s).alias("stray"), n(~p & f & ~s).alias("invented"))
