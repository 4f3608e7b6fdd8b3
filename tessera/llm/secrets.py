"""Secret scans with corpus-wide ownership frequency. DataFrame functions only.

Patterns propose candidates in every text. Each candidate's value is hashed,
and hashes are aggregated over the corpus by distinct repositories and owners:
a value that several owners hold, or that stands in very many repositories of
one, is a widely copied example; a value of one owner looks live. The method's
own kinds report a span only while it looks live; the base kinds report all
their spans and carry the judgement beside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_salted, materialize

# The base kinds in their order, then the method's own kinds.
KEYWORD = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {
    "assign": KEYWORD,
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
OWN_KINDS = {
    "prefixed": r"(?:gh[opsur]_|glpat-|xox[abprs]-|sk-|sk_live_|AIza)[A-Za-z0-9_-]{16,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "pem": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\x0A\x0D\\]*",
    "bearer": r"(?i:bearer)\x20+[A-Za-z0-9+/_.=-]{20,}",
}
# what a text must contain for a kind to be searched at all; none of them drops a match
GATES = {"access": "AKIA", "jwt": "eyJ", "pem": "-----BEGIN "}
LEAST = {"assign": 6, "access": 20, "hex": 24, "pem": 16}
SPAN = "struct<rank:int,kind:string,start:int,stop:int,value:string>"


def _value(kind: str, match: Column) -> Column:
    """The secret itself, without what introduces it; of a key its body, without line ends."""
    if kind == "assign":
        return F.regexp_extract(match, "^" + KEYWORD + "$", 2)
    if kind == "bearer":
        return F.regexp_extract(match, r"^.{6}\x20+(.*)$", 1)
    if kind == "pem":
        return F.regexp_replace(match, r"^.*PRIVATE KEY-----|[\x0A\x0D\\]", "")
    return match


def _found(kind: str, pattern: str, chunk: int = 64) -> Column:
    """array<struct<rank, kind, start, end, value>> of one kind in ``text``.

    The matches and the pieces between them alternate, so that starts are sums
    of lengths, in code points. Spans are gathered ``chunk`` by ``chunk``, since
    an array is copied whenever something is added to it.
    """
    rank = [*KINDS, *OWN_KINDS].index(kind)
    matches = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    pieces = F.split("text", pattern, -1)
    empty = lambda t: F.array().cast(f"array<{t}>")

    def add(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["piece"])
        stop = start + F.length(pair["match"])
        row = F.struct(
            F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), start.alias("start"), stop.alias("stop"),
            _value(kind, pair["match"]).alias("value"),
        )
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    def add_chunk(acc: Column, pairs: Column) -> Column:
        own = F.aggregate(pairs, F.struct(acc["at"].alias("at"), empty(SPAN).alias("out")), add)
        return F.struct(own["at"].alias("at"), F.concat(acc["out"], F.array(own["out"])).alias("out"))

    pairs = F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("piece"), matches.alias("match"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / chunk).cast("int")), lambda i: F.slice(pairs, i * chunk + 1, F.lit(chunk)))
    spans = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), empty(f"array<{SPAN}>").alias("out")), add_chunk, lambda acc: F.flatten(acc["out"]))
    return F.filter(spans, lambda s: F.length(s["value"]) >= LEAST.get(kind, 1))


def _gate(kind: str, pattern: str) -> Column:
    if kind == "hex":  # a run that is too short fails; only a text with a run of 24 needs the spans
        return F.col("text").rlike("[0-9a-f]{24}")
    return F.contains("text", F.lit(GATES[kind])) if kind in GATES else F.col("text").rlike(pattern)


def candidates(documents: DataFrame) -> DataFrame:
    """``spans`` of base and own kinds for every document, by start and then kind."""
    none = F.array().cast(f"array<{SPAN}>")
    # a run of fewer than 24 hex digits is dropped, so maximal runs of 24 and more are the matches
    patterns = {**KINDS, **OWN_KINDS, "hex": "[0-9a-f]{24,}"}
    parts = [F.when(_gate(k, p), _found(k, p)).otherwise(none) for k, p in patterns.items()]
    order = F.array_sort(
        F.concat(*parts),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]),
    )
    return order


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"], F.lit(":"), s["stop"])))


def scan_secrets(
    documents: DataFrame, *, repository: str = "doc_id", owner: str = "source", copied: int = 3, spread: int = 50,
) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, most_owners, most_repositories.

    Base kinds, leftmost and non-overlapping per kind over whole texts: assign
    (its value of 6 or more characters), access (20 or more), hex (24 or
    more). base_sha256 digests ``kind:start:end`` of the base spans by start
    and kind, in code points, end exclusive. spans holds all spans: the base
    ones, and those of the method's own kinds whose value looks live.

    A value looks live while fewer than ``copied`` distinct owners hold it, in
    fewer than ``spread`` distinct repositories; n_live and n_copied count the
    document's spans of either sort, and the last two columns are the largest
    counts of owners and repositories of any of its values (0 without spans).
    Both are counted over all documents; nulls count as one unnamed owner or
    repository. Null texts count as empty. Every input row gives one row, with
    or without a doc_id, repeated rows too. Extra columns are ignored. An empty
    table gives an empty result. Very long texts are searched whole.

    Occurrences are reduced to one row per value and owner, and per value and
    repository, before they are counted, and the judgement of a value meets its
    rows in as many parts as they fill, so that no task gets a whole hot value.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").alias("doc_id"), F.col(repository).cast("string").alias("repo"),
        F.col(owner).cast("string").alias("owner"), text.alias("text"),
    ).withColumn("found", candidates(documents))
    found = materialize(
        rows.withColumn("row", F.when(F.size("found") > 0, F.md5(F.concat_ws("\u0001", "doc_id", "owner", "repo", "text"))))
        .select("doc_id", "repo", "owner", "row", "found")
    )
    hit = found.where("row is not null").groupBy("row").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "repo", "owner", "found")], F.count(F.lit(1)).alias("times")
    )
    values = hit.select("row", "doc_id", "repo", "owner", "times", F.explode("found").alias("s"))
    values = values.withColumn("value", F.sha2("s.value", 256))
    judged = values.groupBy("value").agg(
        F.count_distinct(F.struct("owner")).alias("owners"), F.count_distinct(F.struct("repo")).alias("repos")
    )
    live = (F.col("owners") < copied) & (F.col("repos") < spread)
    marked = join_salted(values, judged, "value", "row").withColumn("live", live)
    again = marked.groupBy("row", "doc_id", "times").agg(
        F.collect_list(F.struct("s.start", "s.rank", "s.kind", "s.stop", "live")).alias("all"),
        F.max("owners").alias("owners"), F.max("repos").alias("repos"),
    ).select("doc_id", F.sort_array("all").alias("all"), "owners", "repos", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("time"))
    clean = found.where("row is null").select(
        "doc_id", F.array().cast("array<struct<start:int,rank:int,kind:string,stop:int,live:boolean>>").alias("all"),
        F.lit(0).cast("long").alias("owners"), F.lit(0).cast("long").alias("repos"),
    )
    base = F.filter("all", lambda s: s["rank"] < len(KINDS))
    kept = F.filter("all", lambda s: (s["rank"] < len(KINDS)) | s["live"])

    def number(kind: str) -> Column:
        return F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return again.drop("time").unionByName(clean).select(
        "doc_id", *[number(k) for k in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(kept).alias("spans"),
        F.size(F.filter("all", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("all", lambda s: ~s["live"])).cast("long").alias("n_copied"),
        F.col("owners").alias("most_owners"), F.col("repos").alias("most_repositories"),
    )
