"""Secrets in texts, told from examples by how many owners have them.

Candidates are found in whole texts: values assigned to secret-like names (kind ``assign``),
access key ids (``access``), long hexadecimal runs (``hex``), and other long runs that mix upper case,
lower case and digits (``owner``). Each candidate's value is counted over the whole corpus: in
how many repositories, of how many owners. A value that at least ``copied`` owners have is an example
that was copied around; others look like live credentials. Candidates of the first three
kinds are always reported; runs of the last kind only where they look live and lie outside
the others.

Only built-in functions are used. A match's place follows from the lengths of the pieces
before it (the text split by the same pattern). Counting is by distinct (value, owner,
repository), then (value, owner), then value, each with partial sums before the exchange; the join
back to places repeats the counts over a few salts, so a value that very many documents have
is dealt over as many tasks. Texts never move, only places and hashes.

Defined results: a null text has no candidates; a null owner or repository counts as one of
its own. Rows with equal ids are scanned one by one; equal rows are one repository and get
equal results. Empty tables give empty results; other columns never matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stored

#: Kinds in the order they are listed, their patterns, the group with the value,
#: and the least length of the value.
KINDS = ("assign", "access", "hex", "owner")
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "owner": (r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
}
#: Owners from whom on a value is an example.
COPIED = 3
SALTS = 16
SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:bigint,mixed:boolean>>"


def matches(text: Column, kind: str) -> Column:
    """Array of spans of one pattern: leftmost, not overlapping, too short values dropped."""
    pattern, group, least = PATTERNS[kind]
    regex = F.lit(pattern)
    number = F.lit(KINDS.index(kind)).cast("int")
    pieces = F.split(text, pattern, -1)
    whole, value = (F.regexp_extract_all(text, regex, F.lit(g)) for g in (0, group))
    parts = F.zip_with(
        F.zip_with(F.slice(pieces, F.lit(1), F.size(pieces) - 1), whole, lambda before, w: F.struct(F.char_length(before).alias("before"), F.char_length(w).alias("size"))),
        value, lambda sizes, v: F.struct(sizes["before"].alias("before"), sizes["size"].alias("size"), v.alias("value")))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + part["before"]
        end = start + part["size"]
        mixed = F.lit(False)
        if kind == "owner":
            mixed = part["value"].rlike("[A-Z]") & part["value"].rlike("[a-z]") & part["value"].rlike("[0-9]")
        span = F.struct(
            start.cast("bigint").alias("start"), number.alias("kind"), end.cast("bigint").alias("end"),
            F.xxhash64(part["value"]).alias("value"), mixed.alias("mixed"))
        wanted = (F.char_length(part["value"]) >= least) & (mixed if kind == "owner" else F.lit(True))
        return F.struct(end.cast("bigint").alias("at"), F.when(wanted, F.array_append(state["out"], span)).otherwise(state["out"]).alias("out"))

    nothing = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"))
    found = F.aggregate(parts, nothing, step, lambda s: s["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def candidates(text: Column) -> Column:
    """All spans of a text, by start and kind; runs of the last kind only outside the others."""
    base = F.concat(*[matches(text, k) for k in KINDS[:3]])
    outside = F.filter(matches(text, "owner"), lambda o: ~F.exists(base, lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"])))
    return F.array_sort(F.concat(base, outside))


def ownership(found: DataFrame) -> DataFrame:
    """Per ``value`` of rows (value, owner, repo): ``n_repos`` and ``n_owners`` over all rows."""
    pairs = found.select("value", "owner", "repo").distinct()
    by_owner = pairs.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("value").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def judged(rows: DataFrame, copied: int) -> DataFrame:
    """Per ``row`` of (row, owner, repo, spans): ``found``, the reported spans with their
    counts and whether they look ``live``, by start and kind."""
    one = rows.select("row", "owner", "repo", F.explode("spans").alias("s")).select("row", "owner", "repo", "s.*")
    one = one.withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.lit(SALTS)))
    counts = ownership(one).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    known = one.join(counts, ["value", "salt"]).withColumn("live", F.col("n_owners") < copied)
    shown = known.where((F.col("kind") < KINDS.index("owner")) | F.col("live"))
    return shown.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "n_repos", "n_owners", "live"))).alias("found"))


FOUND = "array<struct<start:bigint,kind:int,end:bigint,n_repos:bigint,n_owners:bigint,live:boolean>>"


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None, copied: int = COPIED) -> DataFrame:
    """Per row: the id and ``found``. A row is a repository by itself unless ``repo`` says otherwise."""
    repo = F.col(id_col) if repo is None else repo
    owner = F.col("source") if owner is None else owner
    rows = docs.select(F.col(id_col).alias("id"), repo.cast("string").alias("repo"), owner.cast("string").alias("owner"), candidates(F.col(text_col)).alias("spans"))
    # numbered while written, so the numbers are fixed for all later steps
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "secrets")
    return rows.join(judged(rows, copied), "row", "left").select(
        F.col("id").alias(id_col), F.coalesce("found", F.array().cast(FOUND)).alias("found"))


def listed(found: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def of_kind(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")


def redacted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None, copied: int = COPIED, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns, with live-looking spans of the text replaced by ``mark``.

    Only rows with candidates are written and joined; the others pass as they are."""
    repo = F.col(id_col) if repo is None else repo
    owner = F.col("source") if owner is None else owner
    names = docs.columns
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), repo.cast("string").alias("repo"), owner.cast("string").alias("owner"),
        F.col(text_col).alias("text"), candidates(F.col(text_col)).alias("spans"))
    plain = rows.where(F.size("spans") == 0).select("doc")
    some = stored(rows.where(F.size("spans") > 0).withColumn("row", F.monotonically_increasing_id()), "secrets-some")
    known = some.join(judged(some, copied), "row", "left")
    live = F.filter(F.coalesce("found", F.array().cast(FOUND)), lambda s: s["live"])

    def step(state: Column, s: Column) -> Column:
        start = F.greatest(s["start"], state["at"])  # spans of different kinds may overlap
        mark_here = F.when(s["end"] > state["at"], F.lit(mark)).otherwise(F.lit(""))
        return F.struct(
            F.greatest(s["end"], state["at"]).alias("at"),
            F.concat(state["out"], F.when(start > state["at"], F.substring(F.col("text"), (state["at"] + 1).cast("int"), (start - state["at"]).cast("int"))).otherwise(F.lit("")), mark_here).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    cleaned = F.aggregate(live, start, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.char_length("text"))))
    changed = known.select(F.col("doc").withField(text_col, F.when(F.size(live) > 0, cleaned).otherwise(F.col("text"))).alias("doc"))
    return plain.unionByName(changed).select(*[F.col(f"doc.`{c}`").alias(c) for c in names])
