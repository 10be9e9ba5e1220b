"""Public-suffix rules: scan, survey, digest, and the registrable domain of a host."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_HOST, MAX_LABEL = 253, 63
_LDH = re.compile(r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\Z")

#: A small hand-written rule list; a full snapshot is passed as a path instead.
SMALL_RULES = """// ===BEGIN ICANN DOMAINS===
com
net
org
co.uk
*.ck
!www.ck
*.jp
!city.kawasaki.jp
// ===END ICANN DOMAINS===
// ===BEGIN PRIVATE DOMAINS===
github.io
// ===END PRIVATE DOMAINS===
"""


def ascii_host(host: str) -> str | None:
    """The host in ASCII labels (IDNA 2003), lower-cased, without trailing dots; None if it is no host name."""
    host = host.rstrip(".").lower()
    out = []
    for label in host.split("."):
        try:
            label = label if label.isascii() else label.encode("idna").decode("ascii")
        except UnicodeError:
            return None
        label = label.lower()
        if len(label) > MAX_LABEL or not _LDH.match(label):
            return None
        out.append(label)
    name = ".".join(out)
    return name if len(name) <= MAX_HOST else None


def is_address(host: str) -> bool:
    """An IP address, or a host of numeric labels only."""
    bare = host.rstrip(".").strip("[]")
    try:
        ipaddress.ip_address(bare)
        return True
    except ValueError:
        return bool(bare) and all(x.isascii() and x.isdigit() for x in bare.split("."))


@dataclass(frozen=True)
class Rules:
    """Suffix rules by kind: plain names, the bases of wildcards, and exceptions."""

    plain: frozenset[str]
    wildcard: frozenset[str]
    exception: frozenset[str]

    @staticmethod
    def parse(text: str) -> Rules:
        kinds: dict[str, set[str]] = {"": set(), "*.": set(), "!": set()}
        for line in text.splitlines():
            rule = line.strip()
            if not rule or rule.startswith("//"):
                continue
            rule = rule.split()[0]
            mark = "*." if rule.startswith("*.") else "!" if rule.startswith("!") else ""
            name = ascii_host(rule[len(mark) :])
            if name is None:
                raise ValueError(f"not a suffix rule: {line!r}")
            kinds[mark].add(name)
        return Rules(*(frozenset(kinds[k]) for k in ("", "*.", "!")))

    def registrable(self, host: str) -> str | None:
        """The suffix and one label of an ASCII host; None if the suffix is all there is."""
        labels = host.split(".")
        tails = [".".join(labels[i:]) for i in range(len(labels))]
        taken = next((max(1, len(labels) - i - 1) for i, t in enumerate(tails) if t in self.exception), 0)
        if not taken:
            longest = (len(labels) - i for i, t in enumerate(tails) if t in self.plain or t.partition(".")[2] in self.wildcard)
            taken = max(longest, default=1)
        return tails[len(labels) - taken - 1] if taken < len(labels) else None


def rule_rows(spark: SparkSession, text: str) -> DataFrame:
    """(line, section, kind, rule) of every rule of a list's text."""
    lines = spark.createDataFrame(list(enumerate(text.splitlines())), "line long, text string")
    return classify_rules(lines)


def classify_rules(lines: DataFrame) -> DataFrame:
    """Rules with their section: the last section mark above each line.  One list is one small file, hence one ordered pass."""
    mark = F.regexp_extract("text", r"===(BEGIN|END) (ICANN|PRIVATE) DOMAINS===", 1)
    name = F.regexp_extract("text", r"===(BEGIN|END) (ICANN|PRIVATE) DOMAINS===", 2)
    section = F.when(mark == "BEGIN", name).when(mark == "END", F.lit("NONE"))
    marked = lines.withColumn("section", F.last(section, ignorenulls=True).over(Window.orderBy("line")))
    rules = marked.where(~F.trim("text").startswith("//") & (F.trim("text") != ""))
    rule = F.lower(F.trim("text"))
    kind = F.when(rule.startswith("*."), "wildcard").when(rule.startswith("!"), "exception").otherwise("plain")
    return rules.select("line", "section", kind.alias("kind"), F.regexp_replace(rule, r"^(\*\.|!)", "").alias("rule"))


def survey(rules: DataFrame) -> DataFrame:
    """(kind, section, rules): counts by kind and section."""
    return rules.groupBy("kind", "section").agg(F.count("*").alias("rules"))


def digest(rules: DataFrame) -> DataFrame:
    """(digest): sha256 over the rules, the sorted plain ones first, then wildcards, then exceptions, whatever their order in the list."""
    of = lambda kind, mark: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.concat(F.lit(mark), "rule"))))
    return rules.groupBy().agg(F.sha2(F.concat_ws("\n", of("plain", ""), of("wildcard", "*."), of("exception", "!")), 256).alias("digest"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(line, section, kind, rule) of the rule list in a text file: one small published file, read whole to keep its order."""
    return rule_rows(spark, "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def registrable(host: Column | str, rules: Rules) -> Column:
    """The registrable domain of an ASCII host as a native expression: every tail of the host against the literal rules.

    The rule list is published and bounded (about 10,000 rules); lists above 2,000 rules go through
    the UDF of ``functions.urls`` instead, whose sets are looked up by hash.
    """
    if len(rules.plain) + len(rules.wildcard) + len(rules.exception) > 2000:
        raise ValueError("use functions.urls.resolve_links for long rule lists")
    h = F.col(host) if isinstance(host, str) else host
    labels = F.split(h, r"\.")
    n = F.size(labels)
    among = lambda c, names: c.isin(*sorted(names)) if names else F.lit(False)
    tail = lambda k: F.array_join(F.slice(labels, n - k + 1, k), ".")
    lengths = F.sequence(F.lit(1), n)
    exception = F.array_max(F.filter(lengths, lambda k: among(tail(k), rules.exception)))
    matched = F.filter(lengths, lambda k: among(tail(k), rules.plain) | ((k > 1) & among(F.array_join(F.slice(labels, n - k + 2, k - 1), "."), rules.wildcard)))
    taken = F.when(exception.isNotNull(), F.greatest(exception - 1, F.lit(1))).otherwise(F.coalesce(F.array_max(matched), F.lit(1)))
    return F.when(taken < n, F.array_join(F.slice(labels, n - taken, taken + 1), "."))
