"""Chat request bodies: text fields out of JSON, and back into it at their paths."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.validators import provider_of
from veilframe.operators import rewrite
from veilframe.session import written

BLOCK = "struct<type:string,text:string>"


def text_fields(df: DataFrame, id_col: str = "request_id", path_col: str = "path", body_col: str = "body") -> DataFrame:
    """(request_id, field_ord, json_path, text): what a user or system wrote, in the order of the body.

    The system prompt (provider a only) is a string or blocks; a message's content is a string or blocks, of which
    those of type text count. json_path is dotted. Bodies that aren't JSON and paths of no provider have no fields.
    """
    rows = df.select(id_col, provider_of(F.col(path_col)).alias("provider"), F.try_parse_json(F.col(body_col)).alias("v")).where("provider IS NOT NULL")
    part = lambda v, path, kind: F.try_variant_get(v, path, kind)
    v = F.col("v")
    system = F.schema_of_variant(F.try_variant_get(v, "$.system", "variant"))
    messages = F.coalesce(part(v, "$.messages", "array<variant>"), F.array().cast("array<variant>"))

    def blocks(found, start, typed: bool):
        def one(x, i):
            keep = F.lit(True) if not typed else F.coalesce(part(x, "$.type", "string") == "text", F.lit(False))
            said = F.when(keep & (F.schema_of_variant(F.try_variant_get(x, "$.text", "variant")) == "STRING"), part(x, "$.text", "string"))
            return F.struct(F.concat(start, F.lit("."), i.cast("string"), F.lit(".text")).alias("json_path"), said.alias("text"))

        return F.filter(F.transform(F.coalesce(found, F.array().cast("array<variant>")), one), lambda x: x["text"].isNotNull())

    plain = lambda path, text: F.array(F.struct(path.alias("json_path"), text.alias("text")))
    of_system = F.when(F.col("provider") != "a", F.array().cast("array<struct<json_path:string,text:string>>")).when(system == "STRING", plain(F.lit("system"), part(v, "$.system", "string"))).otherwise(blocks(F.when(F.startswith(system, F.lit("ARRAY")), part(v, "$.system", "array<variant>")), F.lit("system"), False))

    def of_message(m, i):
        kind = F.schema_of_variant(F.try_variant_get(m, "$.content", "variant"))
        start = F.concat(F.lit("messages."), i.cast("string"), F.lit(".content"))
        return F.when(kind == "STRING", plain(start, part(m, "$.content", "string"))).otherwise(blocks(F.when(F.startswith(kind, F.lit("ARRAY")), part(m, "$.content", "array<variant>")), start, True))

    fields = F.concat(of_system, F.flatten(F.transform(messages, of_message)))
    return rows.select(id_col, F.posexplode(fields).alias("field_ord", "x")).select(id_col, "field_ord", "x.json_path", "x.text")


def set_paths(body: str | None, paths: list[str], texts: list[str], strict: bool = False) -> str | None:
    """The body with strings set at dotted paths; unknown fields stay.

    Paths that aren't there, or a body that isn't JSON, change nothing; with strict there is no body then.
    """
    if body is None:
        return None
    try:
        root = json.loads(body)
    except ValueError:
        return None if strict else body
    for path, text in zip(paths, texts, strict=True):
        *way, last = [int(p) if p.isdigit() else p for p in path.split(".")]
        at = root
        try:
            for p in way:
                at = at[p]
            at[last]  # noqa: B018
            at[last] = text
        except (KeyError, IndexError, TypeError):
            if strict:
                return None
    return json.dumps(root, ensure_ascii=False, separators=(",", ":"))


def rebuild(df: DataFrame, fields: DataFrame, id_col: str = "request_id", body_col: str = "body", strict: bool = False) -> DataFrame:
    """df with the texts of fields (request_id, json_path, text) put into the bodies; strict as set_paths() has it."""
    own = fields.groupBy(F.col(id_col).alias("__id")).agg(F.array_sort(F.collect_list(F.struct("json_path", "text"))).alias("__f"))

    @F.pandas_udf("string")
    def put(bodies: pd.Series, paths: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([b if p is None else set_paths(b, list(p), list(t), strict) for b, p, t in zip(bodies, paths, texts, strict=True)], dtype=object)

    joined = df.join(own, F.col(id_col) == F.col("__id"), "left")
    body = F.when(F.col("__f").isNull(), F.col(body_col)).otherwise(put(F.col(body_col), F.col("__f.json_path"), F.col("__f.text")))
    return joined.withColumn(body_col, body).drop("__id", "__f")


def convert_documents(df: DataFrame, body_col: str = "body") -> DataFrame:
    """df with document blocks of base64 PDF or DOCX made text blocks, and converted, their number. Others stay."""
    from veilframe.sources.documents import block_text

    def change(node, count: list[int]):
        if isinstance(node, list):
            return [change(x, count) for x in node]
        if isinstance(node, dict):
            if node.get("type") == "document" and (text := block_text(node)) is not None:
                count[0] += 1
                return {"type": "text", "text": text}
            return {k: change(x, count) for k, x in node.items()}
        return node

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies, counts = [], []
            for body in batch[body_col]:
                count = [0]
                try:
                    new = change(json.loads(body), count) if body and '"document"' in body else None
                except ValueError:
                    new = None
                bodies.append(json.dumps(new, ensure_ascii=False, separators=(",", ":")) if count[0] else body)
                counts.append(count[0])
            yield batch.assign(**{body_col: bodies, "converted": counts})

    return df.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", converted int")


def model_of(body):
    return F.get_json_object(body, "$.model")


def pseudonymize_requests(df: DataFrame, known: DataFrame | None = None, salt: str = "", id_col: str = "request_id", path_col: str = "path", body_col: str = "body", passthrough: bool = False, **options) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(requests with rewritten bodies and counts, the mapping used, quarantined requests).

    With passthrough, bodies of known paths stay as they came, and count no entities.

    pii_count and pii_types (TYPE:n, sorted) are of the request. Entities that known lacks get pseudonyms, which the
    mapping used has too. A request is known by its path and body: ids may be null or repeat. Bodies without entities
    and documents stay as they came. A body that isn't JSON, one that can't be rewritten, and a path of no provider go
    to the third table as they came, and never to the first: nothing that failed is passed on.
    """
    good = F.coalesce(F.try_parse_json(F.col(body_col)).isNotNull() & provider_of(F.col(path_col)).isNotNull(), F.lit(False))
    if passthrough:
        routed = provider_of(F.col(path_col)).isNotNull()
        same = df.where(routed).withColumn("pii_count", F.lit(0).cast("long")).withColumn("pii_types", F.array().cast("array<string>"))
        return same, known, df.where(~routed)
    keyed = df.where(good).withColumn("__key", F.sha2(F.concat_ws("\n", path_col, body_col).cast("binary"), 256))
    once = keyed.groupBy("__key").agg(F.first(path_col).alias("path"), F.first(body_col).alias("body"))
    bodies = written(convert_documents(once), "bodies")
    done = rewrite.run(text_fields(bodies, "__key"), "__key", "text", known, salt, **options)
    by_type = done.replaced.groupBy("__key", "entity_type").agg(F.count("*").alias("n"))
    counts = by_type.groupBy("__key").agg(F.sum("n").alias("pii_count"), F.array_sort(F.collect_list(F.concat_ws(":", "entity_type", F.col("n").cast("string")))).alias("pii_types"))
    fields = done.changed.join(counts.select("__key"), "__key", "left_semi")
    new = rebuild(bodies, fields, "__key", "body", strict=True).join(counts, "__key", "left").select("__key", F.col("body").alias("__body"), "pii_count", "pii_types")
    new = written(new, "rewritten")
    both = keyed.join(new, "__key")
    body = lambda c: F.col("__body").alias(c) if c == body_col else F.col(c)
    out = both.where("__body IS NOT NULL").select(*map(body, df.columns), F.coalesce("pii_count", F.lit(0)).alias("pii_count"), F.coalesce("pii_types", F.array().cast("array<string>")).alias("pii_types"))
    failed = both.where("__body IS NULL").select(*df.columns)
    return out, done.known, df.where(~good).unionByName(failed)


def _json(body: str | None):
    try:
        return json.loads(body) if body else None
    except ValueError:
        return None


def _strings(node) -> Iterator[str]:
    """The strings of a JSON value, in order; keys aren't among them."""
    if isinstance(node, str):
        yield node
    elif isinstance(node, (list, dict)):
        for x in node.values() if isinstance(node, dict) else node:
            yield from _strings(x)


def _changed(node, texts: Iterator[str]):
    """The value with its strings replaced in order."""
    if isinstance(node, str):
        return next(texts)
    if isinstance(node, list):
        return [_changed(x, texts) for x in node]
    return {k: _changed(x, texts) for k, x in node.items()} if isinstance(node, dict) else node


def _taken(body: str | None) -> list[str]:
    """What is to be restored of a body: the strings of JSON, or else the text itself."""
    root = _json(body)
    return [body] if root is None and body else [*_strings(root)]


def _put_back(body: str | None, texts: list[str]) -> str | None:
    root = _json(body)
    if root is None:
        return texts[0] if texts else body
    return json.dumps(_changed(root, iter(texts)), ensure_ascii=False, separators=(",", ":"))


def restore_responses(df: DataFrame, known: DataFrame, body_col: str = "body") -> DataFrame:
    """df with pseudonyms replaced by originals in the strings of JSON bodies, which are decoded and encoded again.

    Keys stay. A body that isn't JSON is restored as text. A mapping that is too large to send is joined with the
    strings instead; the result is the same.
    """
    pairs = known.select("pseudonym", "original")
    if (held := rewrite._sent(pairs)) is not None:

        @F.pandas_udf("string")
        def put(bodies: pd.Series) -> pd.Series:
            automaton = rewrite._automaton(held.value[0])
            change = lambda t: rewrite.put(t, rewrite.leftmost_longest(t, automaton))
            return pd.Series([_put_back(b, [change(t) for t in _taken(b)]) for b in bodies], dtype=object)

        return df.withColumn(body_col, put(F.col(body_col)))

    @F.pandas_udf("array<string>")
    def take(bodies: pd.Series) -> pd.Series:
        return pd.Series([_taken(b) for b in bodies], dtype=object)

    @F.pandas_udf("string")
    def put_all(bodies: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([_put_back(b, list(t) if t is not None else []) for b, t in zip(bodies, texts, strict=True)], dtype=object)

    keyed = df.withColumn("__key", F.sha2(F.col(body_col).cast("binary"), 256))
    strings = keyed.where("__key IS NOT NULL").groupBy("__key").agg(F.first(body_col).alias("b")).select("__key", F.posexplode(take("b")).alias("i", "text"))
    back = rewrite.restore(strings, known).groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("__x"))
    joined = keyed.join(back, "__key", "left")
    return joined.withColumn(body_col, put_all(F.col(body_col), F.col("__x.text"))).select(*df.columns)
