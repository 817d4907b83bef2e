"""Operator 8: personal data by seeds and bootstrapped contexts.

Seeds are the spans of four fixed forms (e-mail, IP address, card, phone), and tokens in
the form of a key or secret (``secret``). The words
around a seed are lexical patterns: the word before it, the two words before it, and
the word before with the word after. The graph of patterns and instances holds
seeds and candidates, that is tokens of five characters or more with a digit which no
seed covers. Spark scores it in rounds: a pattern's confidence is the confidence of its
instances over all its occurrences in the corpus (of whatever word stands there);
an instance's is that of its best pattern, a seed's is 1. Patterns need enough
different instances trusted before, so candidates found in one round induce patterns
in the next. Candidates whose instance is trusted in the end become spans of kind
``id`` wherever they stand.

Patterns, instances and scores stay in tables; what goes to the tasks is a bit map of
fixed size that tells which contexts need to be counted."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bitmaps import in_map, sized_map
from tessera.llm.words import chunked, mixed, released, signed, slices, split, unused, utf8
from tessera.plans.staging import staged

KINDS = ("email", "ip", "card", "phone", "secret", "id")
SECRET, CANDIDATE = 4, 5
ROUNDS, SUPPORT, CONFIDENCE = 3, 3, 0.6
#: How much text around a span is read for its words at first.
AROUND = 160

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE_RUN = re.compile(r"\+([0-9][ ().0-9-]+)")
_NO_DIGIT = re.compile(r"[^0-9]+")
_TAIL = re.compile(r"[0-9]\S*")
#: Keys by their form: hexadecimal digests, and the marked formats of well-known services.
_SECRET = re.compile(
    r"(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+){2}"
)
_EDGE = "\"'`()[]{}<>,.;:!?#$%&*|=~^"
_LOCAL = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """E-mail addresses, leftmost and without overlap, in time linear in the text:
    an address starts where the run of its first part before an @ starts."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (c := ord(text[start - 1])) < 128 and c in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1  # no address reaches over this @
        at = text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the four fixed forms, by kind and start."""
    found = [(0, a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m[0].split("."))):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    for m in _PHONE_RUN.finditer(text):
        end = m.end()
        while text[end - 1] not in "0123456789":
            end -= 1
        if end - m.start(1) >= 3 and 9 <= len(_NO_DIGIT.sub("", text[m.start() : end])) <= 15:
            found.append((3, m.start(), end))
    return found


def candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of the tokens of five characters or more with a digit, outside of
    spans: of kind SECRET by their form, or else CANDIDATE. Marks at their ends aren't part."""
    spans, k = sorted((a, b) for _, a, b in taken), 0
    for m in _TAIL.finditer(text):
        start, end = m.span()
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        if end - start < 5:
            continue
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        if k < len(spans) and spans[k][0] < end:
            continue
        yield SECRET if _SECRET.fullmatch(text, start, end) else CANDIDATE, start, end


def _hashes(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    return split(np.frombuffer(data, np.uint8), np.array([0, len(data)]), False).hash


_ONE, _TWO, _AROUND = np.uint64(0x51ED270B), np.uint64(0xA24BAED5), np.uint64(0x7FB5D329)


def _keys(before2: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys of the three patterns; 0 stands for no word."""
    return (
        mixed(before ^ _ONE),
        mixed(mixed(before2 ^ _TWO) + before),
        mixed(mixed(before + _AROUND) ^ after),
    )


_BLANK, _BLANKS = " \t\n\x0b\x0c\r", re.compile(r"[ \t-\r]+")


def _words_before(text: str, a: int) -> list[str]:
    """Up to two whole words before a place."""
    size = AROUND
    while True:
        low = max(0, a - size)
        words = _BLANKS.split(text[low:a])
        if low == 0 or len(words) > 3:  # the first one may be cut, the last one is empty
            return [w for w in (words if low == 0 else words[1:]) if w][-2:]
        size *= 4


def _word_after(text: str, b: int) -> list[str]:
    size = AROUND
    while True:
        words = _BLANKS.split(text[b : b + size])
        if b + size >= len(text) or len(words) > 2:
            return [w for w in words if w][:1]
        size *= 4


def contexts(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Pattern keys of each span, three to a row; a key is 0 where a word is missing.

    Quotes and other marks around a span count as part of it; where more stands
    before it in its word, it has no context."""
    words, picks = [], []
    for a, b in spans:
        while a > 0 and text[a - 1] in _EDGE:
            a -= 1
        while b < len(text) and text[b] in _EDGE:
            b += 1
        left, right = _words_before(text, a), _word_after(text, b)
        glued = a > 0 and text[a - 1] not in _BLANK
        trailing = b < len(text) and text[b] not in _BLANK
        pick = [len(words) + i if i >= 0 else -1 for i in (len(left) - 2, len(left) - 1)]
        pick.append(len(words) + len(left) + 1 if right else -1)
        words += [*left, "x", *right]
        picks.append((pick, glued, trailing))
    if not spans:
        return np.empty((0, 3), np.uint64)
    codes = np.append(_hashes(words), np.uint64(0))
    at = np.array([p for p, *_ in picks])
    b2, b1, after = (codes[at[:, k]] for k in range(3))
    out = np.stack(_keys(b2, b1, after), axis=1)
    missing = np.stack((at[:, 1] < 0, at[:, 0] < 0, (at[:, 1] < 0) | (at[:, 2] < 0)), axis=1)
    missing[[g for _, g, _ in picks]] = True  # it is part of the word before
    missing[[t for *_, t in picks], 2] = True
    out[missing] = 0
    return out


_FOUND = "found array<struct<kind:int,a:int,b:int,value:long,keys:array<long>>>"


def extract(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``uid, doc_id, code, found``: seeds (kind 0-4) and
    candidates (kind 5) with their pattern keys, a row per row; code hashes the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64()), ("keys", pa.list_(pa.int64()))]))
        for batch in batches:
            ids, texts = batch.column("doc_id"), utf8(batch.column("text"))
            for lo in range(0, len(texts), 512):
                out = []
                part = texts[lo : lo + 512].to_pylist()
                for text in part:
                    base = base_spans(text)
                    spans = base + list(candidates(text, base))
                    if not spans:
                        out.append([])
                        continue
                    keys = signed(contexts(text, [(a, b) for _, a, b in spans])).tolist()
                    values = signed(_hashes([re.sub(r"\s", "_", text[a:b]) for _, a, b in spans])).tolist()
                    out.append([{"kind": k, "a": a, "b": b, "value": v, "keys": x} for (k, a, b), v, x in zip(spans, values, keys, strict=True)])
                uids = pa.array(range(uid, uid + len(part)), pa.int64())
                uid += len(part)
                yield pa.RecordBatch.from_arrays([uids, ids[lo : lo + 512], batch.column("code")[lo : lo + 512], pa.array(out, kind)], ["uid", "doc_id", "code", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("code"))
    return rows.mapInArrow(released(run), f"uid long, doc_id long, code long, {_FOUND}")


def occurrences(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """``key, n``: how often each mapped context occurs around any word (or span)."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["key", "n"])
            found.clear()
            return batch

        for batch in batches:
            for _, _, data, offsets in chunked(batch.column("text")):
                w = split(data, offsets, False)
                h, row = np.pad(w.hash, (2, 1)), np.concatenate(([-1, -1], w.row, [-1]))
                same = lambda x, y: row[x:y] == row[2:-1]
                n = len(h)
                b1, b2, af = np.where(same(1, n - 2), h[1 : n - 2], 0), np.where(same(0, n - 3), h[: n - 3], 0), np.where(same(3, n), h[3:], 0)
                one, two, both = _keys(b2.astype(np.uint64), b1.astype(np.uint64), af.astype(np.uint64))
                keys = np.concatenate((one[b1 != 0], two[b2 != 0], both[(b1 != 0) & (af != 0)]))
                keys, counts = np.unique(keys[in_map(sent.value, keys)], return_counts=True)
                found.update(dict(zip(signed(keys).tolist(), counts.tolist(), strict=True)))
            if len(found) > 200_000:
                yield out()
        yield out()

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(released(run), "key long, n long")
    return counted.groupBy("key").agg(F.sum("n").alias("occurs"))


def trusted_values(docs: DataFrame, found: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """``value`` of the instances that are seeds, or stand behind a confident pattern.

    In each round the instances trusted so far, seeds or candidates, induce the patterns
    that hold ``support`` of them; only new patterns are counted in the corpus. There are
    ``rounds`` rounds, and more as long as one brings a new pattern or instance."""
    spans = found.select(F.explode("found").alias("f")).select("f.kind", "f.value", "f.keys")
    seeds = staged(spans.where(F.col("kind") < CANDIDATE).select("value").distinct(), "seeds")
    edges = staged(spans.select("value", F.explode("keys").alias("key")).where("key <> 0").groupBy("key", "value").agg(F.count(F.lit(1)).alias("n")), "edges")
    # fewer different instances never make a pattern
    held = edges.groupBy("key").agg(F.sum("n").alias("spans"), F.count(F.lit(1)).alias("values")).where(F.col("values") >= support)
    edges = staged(edges.join(held.select("key", "spans"), "key"), "held")
    seeded = seeds.withColumn("trust", F.lit(1.0))
    trusted, total, before, turn = seeded, None, -1, 0
    while True:
        backed = edges.join(trusted, "value").groupBy("key").agg(F.sum(F.col("n") * F.col("trust")).alias("weight"), F.max("spans").alias("spans"), F.count(F.when(F.col("trust") >= confidence, 1)).alias("backing"))
        backed = staged(backed.where(F.col("backing") >= support), "patterns")
        new = staged((backed if total is None else backed.join(total, "key", "left_anti")).select("key"), "new")
        more = not new.isEmpty()
        if more:
            # a key that the corpus never shows between its words counts 0 and isn't asked again
            counted = new.join(occurrences(docs, sized_map(new)), "key", "left").select("key", F.coalesce("occurs", F.lit(0)).alias("occurs"))
            counted = staged(counted, "occurrences")
            total = counted if total is None else total.union(counted)
        if total is None:
            return seeds
        # a pattern's confidence is at most its share of seeds and candidates
        live = backed.join(total.where("occurs > 0"), "key").where(F.col("spans") >= confidence * F.col("occurs"))
        scored = live.select("key", F.least(F.lit(1.0), F.col("weight") / F.greatest("occurs", "spans")).alias("score"))
        best = edges.join(scored, "key").groupBy("value").agg(F.max("score").alias("trust")).join(seeds, "value", "left_anti")
        trusted = staged(seeded.unionByName(best), "trusted")
        now, turn = trusted.where(F.col("trust") >= confidence).count(), turn + 1
        if turn >= rounds and not more and now == before:
            return trusted.where(F.col("trust") >= confidence).select("value")
        before = now


def added_spans(found: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """The candidates whose instance is trusted, wherever they stand, of each row or group of equal rows."""
    tokens = found.select(*by, F.explode("found").alias("f")).where(F.col("f.kind") == CANDIDATE).select(*by, "f.a", "f.b", "f.value")
    return tokens.join(values, "value").groupBy(*by).agg(F.collect_set(F.struct(F.lit(CANDIDATE).alias("kind"), "a", "b")).alias("added"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``uid, doc_id, base, spans``, a row per row: arrays of
    (kind, a, b), ordered, of the fixed forms and of all; kinds are numbered as in KINDS.

    A null text is empty and has no span; null or repeated doc_ids and repeated rows
    stay as they are; other columns are ignored. Offsets count code points."""
    found = staged(extract(docs), "found")
    added = added_spans(found, trusted_values(docs, found), ["uid"])

    def below(kind: int) -> Column:
        kept = F.filter("found", lambda f: f["kind"] < kind)
        return F.array_sort(F.transform(kept, lambda f: F.struct(f["kind"].alias("kind"), f["a"].alias("a"), f["b"].alias("b"))))

    rows = found.select("uid", "doc_id", below(SECRET).alias("base"), below(CANDIDATE).alias("sure"))
    spans = F.when(F.col("added").isNull(), F.col("sure")).otherwise(F.array_sort(F.concat("sure", "added")))
    return rows.join(added, "uid", "left").select("uid", "doc_id", "base", spans.alias("spans"))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["a"], s["b"])), ",")


def count_of(spans: Column, kind: int) -> Column:
    # a lambda with a second parameter would be given the position
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    count = [count_of(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return find_personal_data(docs).select("doc_id", *count, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of its ``text`` replaced by its kind in brackets, and
    ``n_chars`` (where it exists) set to the new length; a row per row.

    A null text stays null; rows are told apart by doc_id and text, so equal rows
    get the same spans. Added spans are joined to the texts; Spark broadcasts them
    if their table is below its limit, and else shuffles both."""
    code, more, key, id_ = (unused(docs.columns, f"__pii_{n}") for n in ("code", "added", "key", "id"))
    found = staged(extract(docs), "found")
    added = added_spans(found, trusted_values(docs, found), ["doc_id", "code"])
    added = staged(added.select(F.col("doc_id").alias(id_), F.col("code").alias(key), F.col("added").alias(more)), "added")
    schema, names = docs.schema, docs.columns
    lengths = "n_chars" in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for text, extra in zip(batch.column("text").to_pylist(), batch.column(more).to_pylist(), strict=True):
                base = base_spans(text or "")
                spans = base + [x for x in candidates(text or "", base) if x[0] == SECRET] + [(x["kind"], x["a"], x["b"]) for x in extra or ()]
                texts.append(replaced(text, spans))
            columns = {n: batch.column(n) for n in names}
            columns["text"] = pa.array(texts, columns["text"].type)
            if lengths:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    rows = docs.withColumn(code, F.xxhash64("text"))
    joined = rows.join(added, (F.col("doc_id").cast("long").eqNullSafe(F.col(id_))) & (F.col(code) == F.col(key)), "left")
    return joined.select(*names, more).mapInArrow(released(run), schema)


def replaced(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each (kind, start, end) replaced; of overlapping ones, the first."""
    out, done = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= done:
            out += [text[done:a], f"[{KINDS[k].upper()}]"]
            done = b
    return "".join([*out, text[done:]]) if out else text
