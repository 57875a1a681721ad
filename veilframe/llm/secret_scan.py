"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Each candidate's value is hashed, and hashes are counted by distinct repositories and owners over the whole corpus.
A value that many owners have, or one owner in many repositories, is an example that was copied about; one that a
single owner has in few repositories looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import col, write_table
from veilframe.llm.spans import found, listed, row_key

#: The patterns of the base kinds, in the order of the kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Candidates that count only where they look live: long runs with upper case, lower case and digits.
LOOSE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}"
KINDS = ("assign", "access", "hex", "live")
#: Owners, or repositories of one owner, from which a value is an example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 50
_SPAN = "array<struct<s:int,k:int,e:int,kind:string,hash:string>>"


def _kind(text: Column, k: int, likely: Column, pattern: str, value=lambda v: v, keep=lambda v: F.lit(True)) -> Column:
    one = lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(KINDS[k]).alias("kind"), F.sha2(value(x["v"]).cast("binary"), 256).alias("hash"))
    return F.when(likely, F.transform(F.filter(found(text, pattern), lambda x: keep(x["v"])), one)).otherwise(F.array().cast(_SPAN))


def candidates(text: Column) -> Column:
    """All candidate spans of a text by start, then kind: array of (s, k, e, kind, hash of the value)."""
    assigned = lambda v: F.regexp_extract(v, ASSIGN, 2)
    mixed = lambda v: v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]")
    return F.array_sort(
        F.concat(
            _kind(text, 0, text.rlike(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""), ASSIGN, assigned, lambda v: F.length(assigned(v)) >= 12),
            _kind(text, 1, F.contains(text, F.lit("AKIA")), ACCESS),
            _kind(text, 2, text.rlike("[0-9a-f]{16}"), HEX),
            _kind(text, 3, text.rlike(LOOSE), LOOSE, keep=mixed),
        )
    )


def ownership(spans: DataFrame, repo: str, owner: str) -> DataFrame:
    """(hash, repositories, owners): distinct ones of each value. A null repository or owner counts as one more.

    Rows are aggregated by value, owner and repository before any key gathers more than that.
    """
    once = spans.groupBy("hash", owner, repo).agg(F.lit(1).alias("one"))
    by_owner = once.groupBy("hash", owner).agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """(doc_id, spans, n_live, n_example) for each row of docs.

    spans: array of (s, k, e, kind, hash), in code points, by start, then kind: all base candidates (assign, access,
    hex), and of kind live the loose ones whose value looks live: a single owner has it, in fewer than
    example_repositories. n_live and n_example count a row's distinct values that look live, and those that
    example_owners have, or that are in example_repositories, or more.

    A null text is empty and has no spans. Null ids, repositories and owners are values like others. Repeated rows are
    kept, and count as one repository if they name one. Other columns are ignored.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    rows = docs.select(col(id_col).alias("doc_id"), row_key(col(id_col), text).alias("key"), col(repo_col).cast("string").alias("repo"), col(owner_col).cast("string").alias("owner"), candidates(text).alias("found"))
    rows = write_table(rows, "secrets")
    spans = rows.where(F.size("found") > 0).select("key", "repo", "owner", F.explode("found").alias("x")).select("key", "repo", "owner", "x.*")
    counted = ownership(spans, "repo", "owner")
    example = (F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories)
    live = (F.col("owners") == 1) & (F.col("repositories") < example_repositories)
    named = spans.select("key", "s", "k", "e", "kind", "hash").distinct().join(counted.select("hash", live.alias("live"), example.alias("example")), "hash")
    judged = named.where((F.col("k") < 3) | F.col("live")).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("s", "k", "e", "kind", "hash"))).alias("spans"),
        F.size(F.collect_set(F.when(F.col("live"), F.col("hash")))).cast("long").alias("n_live"),
        F.size(F.collect_set(F.when(F.col("example"), F.col("hash")))).cast("long").alias("n_example"),
    )
    whole = rows.select("doc_id", "key").join(judged, "key", "left")
    return whole.select("doc_id", F.coalesce("spans", F.array().cast(_SPAN)).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))


def digest(result: DataFrame) -> DataFrame:
    """The counts and digests of secrets()."""
    base = F.filter("spans", lambda x: x["k"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    return result.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), "n_live", "n_example")
