"""JSON values and structs: redaction, dropped payloads, merges."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys of secrets, in any case, and keys of encoded images, as they are (fixed values).
SECRET_KEYS = ("apikey", "authorization", "token", "password", "secret")
PAYLOAD_KEYS = ("b64_json", "image_b64", "image_base64")
REDACTED = "[redacted]"


def _rewritten(c: Column, kind: T.DataType, hit: Callable[[Column], Column], named: Callable[[str], bool], value: Callable[[T.DataType], Column]) -> Column:
    """The value with fields (and keys of maps) that are hit replaced, at any depth; null stays
    null. A VARIANT may hold any key, so it can't be rewritten and is refused."""
    again = lambda x, t: _rewritten(x, t, hit, named, value)
    if isinstance(kind, T.StructType):
        fields = [(value(f.dataType) if named(f.name) else again(c[f.name], f.dataType)).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: again(x, kind.elementType))
    if isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            return F.transform_values(c, lambda k, v: again(v, kind.valueType))
        new = value(kind.valueType)
        if not isinstance(kind.valueType, T.StringType):
            new = F.lit(None).cast(kind.valueType)
        return F.transform_values(c, lambda k, v: F.when(hit(k), new).otherwise(again(v, kind.valueType)))
    if isinstance(kind, T.VariantType):
        raise ValueError("a VARIANT has to be given a schema before its secrets or payloads can be taken out")
    return c


def redact(df: DataFrame, cols: list[str]) -> DataFrame:
    """Secrets in struct and map columns, at any depth, replaced by a mark. A secret field of a
    struct becomes a string whatever its type; in a map whose values are no strings it becomes
    null, as all values of a map have one type. A VARIANT is an error."""
    mark = lambda kind: F.lit(REDACTED)
    return df.withColumns({c: _rewritten(F.col(c), df.schema[c].dataType, lambda k: F.lower(k).isin(*SECRET_KEYS), lambda n: n.lower() in SECRET_KEYS, mark) for c in cols})


def null_payloads(df: DataFrame, cols: list[str]) -> DataFrame:
    """Encoded images in struct and map columns set to null, their place kept; a VARIANT is an error."""
    none = lambda kind: F.lit(None).cast(kind)
    return df.withColumns({c: _rewritten(F.col(c), df.schema[c].dataType, lambda k: k.isin(*PAYLOAD_KEYS), lambda n: n in PAYLOAD_KEYS, none) for c in cols})


def strict_json(c: Column) -> Column:
    """JSON text as VARIANT if all of it is one value, else null; a JSON null is a variant null.

    Spark's own function takes the first value and ignores what follows. So the text is made the
    first item of an array whose second is the text's digest: only where that is read back did
    the first end where the text does. An object that repeats a key, a text beyond the size of
    a VARIANT, and one nested deeper than 1,000 are no JSON here."""
    mark = F.sha2(c, 256)
    both = F.try_parse_json(F.concat(F.lit("["), c, F.lit(',"'), mark, F.lit('"]')))
    return F.when(F.try_variant_get(both, "$[1]", "string") == mark, F.try_variant_get(both, "$[0]", "variant"))


def redact_json(c: Column) -> Column:
    """Secrets in JSON text of any shape; null stays null, and text that is no JSON becomes a
    JSON string that says so, as it might hold anything (see :func:`unreadable`).

    Schemas of free-form JSON aren't known, so this is a Python function over batches. Of a
    repeated key the last value stays, as parsers that users know do it."""
    return _json_udf(_redacted)(c)


def null_payloads_json(c: Column) -> Column:
    """Encoded images in JSON text of any shape, as :func:`redact_json`."""
    return _json_udf(_without_payloads)(c)


def sanitized_json(c: Column, indent: int | None = None) -> Column:
    """Both rules of :func:`redact_json` and :func:`null_payloads_json` in one pass; with an
    indent on lines of their own."""
    return _json_udf(lambda k, v: _without_payloads(k, _redacted(k, v)), indent)(c)


#: What stands for text that is no JSON.
UNREADABLE = '"[unreadable]"'


def unreadable(c: Column) -> Column:
    """Whether text is there that is no JSON, by the parser of :func:`redact_json`: the rows to look at."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: None if text is None else _parsed(text)[1])

    return c.isNotNull() & run(c)


def _redacted(k: str, v: object) -> object:
    return REDACTED if k.lower() in SECRET_KEYS else v


def _without_payloads(k: str, v: object) -> object:
    return None if k in PAYLOAD_KEYS else v


def _parsed(text: str) -> tuple[object, bool]:
    """A JSON text's value, and whether it is none."""

    def refuse(name: str) -> None:
        raise ValueError(f"{name} is no JSON")

    try:
        return json.loads(text, parse_constant=refuse), False
    except (ValueError, RecursionError):
        return None, True


def _json_udf(rule: Callable[[str, object], object], indent: int | None = None):
    def walk(v):
        if isinstance(v, list):
            return [walk(x) for x in v]
        if isinstance(v, dict):
            return {k: walk(x) if (x := rule(k, y)) is y else x for k, y in v.items()}
        return v

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        value, bad = _parsed(text)
        try:
            return UNREADABLE if bad else json.dumps(walk(value), ensure_ascii=False, indent=indent, separators=(",", ":" if indent is None else ": "))
        except RecursionError:
            return UNREADABLE

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run


def deep_merge(base: Column, patch: Column, kind: T.DataType) -> Column:
    """Two values of one type, the patch's leaves first; its nulls give nothing. Arrays are
    joined, the patch's elements first, as the merge of settings that users know does it."""
    if isinstance(kind, T.StructType):
        return F.struct(*(deep_merge(base[f.name], patch[f.name], f.dataType).alias(f.name) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return F.when(base.isNotNull() & patch.isNotNull(), F.concat(patch, base)).otherwise(F.coalesce(patch, base))
    return F.coalesce(patch, base)


def layer_budgets(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """``category, timeout, max_retries, retry_intervals``: each leaf of the override if it is
    valid (timeout above 0, retries not negative, intervals all finite and not negative), else the default's."""
    o = overrides.select("category", F.col("timeout").alias("t"), F.col("max_retries").alias("m"), F.col("retry_intervals").alias("i"))
    rows = defaults.join(o, "category", "left")
    pick = lambda valid, new, old: F.when(F.coalesce(valid, F.lit(False)), F.col(new)).otherwise(F.col(old)).alias(old)
    return rows.select("category", pick(F.col("t") > 0, "t", "timeout"), pick(F.col("m") >= 0, "m", "max_retries"), pick(F.forall("i", lambda x: (x >= 0) & (x < float("inf")) & ~F.isnan(x)), "i", "retry_intervals"))


def mask_defaults(args: DataFrame, section: str = "chroma") -> DataFrame:
    """Unset arguments of a mask (``key, preserve_interior, border_sample, saturation_ratio``) filled
    from the row's settings, a struct column (``color`` and the same names but ``key``).

    What the caller gave wins, also false and 0; a blank colour gives no key."""
    of = lambda name: F.col(f"{section}.{name}")
    filled = {n: F.coalesce(n, of(n)) for n in ("preserve_interior", "border_sample", "saturation_ratio")}
    return args.withColumns({"key": F.coalesce(F.col("key"), F.nullif(of("color"), F.lit("")))} | filled)


def request_record(requests: DataFrame, params: list[str]) -> DataFrame:
    """``requests(prompt, n, chroma_color, ...)`` with ``request``, the JSON of the parameters named,
    prompt and number, and of the key colour only where one was used (not null, not blank).
    Parameters without a value are left out."""
    chroma = F.when(F.coalesce("chroma_color", F.lit("")) != "", F.struct(F.col("chroma_color").alias("color")))
    return requests.withColumn("request", F.to_json(F.struct(*params, "prompt", "n", chroma.alias("chroma"))))


def parse_verdicts(responses: DataFrame) -> DataFrame:
    """``response_id, refusal, finish_reason, content`` -> ``response_id, status, ok, score, reasons``.

    status: refusal, content_filter, length (checked in this order, before the content), empty,
    not_json (see :func:`strict_json`: also where something follows the value), off_schema or
    verdict. The score is held to 0..1; a fault has no verdict."""
    v = strict_json(F.col("content"))
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    score_kind = kind("$.score")
    reasons = F.try_variant_get(v, "$.reasons", "array<variant>")
    numeric = score_kind.isin("BIGINT", "DOUBLE") | score_kind.startswith("DECIMAL")
    strict = (kind("$.ok") == "BOOLEAN") & numeric & (kind("$.reasons").startswith("ARRAY")) & F.forall(reasons, lambda r: F.schema_of_variant(r) == "STRING")
    status = (
        F.when(F.coalesce(F.col("refusal"), F.lit("")) != "", "refusal")
        .when(F.col("finish_reason") == "content_filter", "content_filter")
        .when(F.col("finish_reason") == "length", "length")
        .when(F.coalesce(F.col("content"), F.lit("")) == "", "empty")
        .when(v.isNull(), "not_json")
        .when(F.coalesce(strict, F.lit(False)), "verdict")
        .otherwise("off_schema")
    )
    rows = responses.withColumn("status", status)
    good = F.col("status") == "verdict"
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_variant_get(v, "$.score", "double")))
    return rows.select("response_id", "status", F.when(good, F.try_variant_get(v, "$.ok", "boolean")).alias("ok"), F.when(good, score).alias("score"), F.when(good, F.try_variant_get(v, "$.reasons", "array<string>")).alias("reasons"))
