r"""Operator 6: chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it as context, and its
reply as the only trainable text. The examples of a conversation are prefixes of
one formatted text, whose pieces, a turn each, :func:`format_conversations` makes;
:func:`expanded` writes each example out with its context and the span of its
reply, and :func:`read_back` reads turns and replies from these texts. Turns after the last assistant turn are a last
row without a reply (``trainable`` false), so nothing of a conversation is lost.

Template: ``<|im_start|>role\ntext<|im_end|>\n``. Escapes in role and text: a
backslash is doubled, and one is put inside each control string of this and of
other common templates, so that none of them is left in a text; removing each
backslash and keeping the character after it gives the text back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"


def escaped(c: Column) -> Column:
    """The text with a backslash before each backslash and in each control string."""
    c = F.regexp_replace(c, r"\\", r"\\\\")
    c = F.regexp_replace(c, r"<\|", r"<\\|")
    c = F.regexp_replace(c, r"\[(/?INST\])", r"[\\$1")
    return F.regexp_replace(c, r"<(/?s>)", r"<\\$1")


def escaped_role(c: Column) -> Column:
    """As a text, with a backslash before line breaks too: the first bare one ends a role."""
    return F.regexp_replace(escaped(c), "\n", "\\\\\n")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_conversations(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> the prefix chains, a row per turn:
    ``conv_id, position, example, trainable, piece, prefix_chars, loss_start, loss_end``.

    A row is the piece of one turn; ``example`` numbers the example whose text it
    belongs to, and the loss span (offsets within the piece; equal where the turn
    isn't the example's reply) is the escaped text of the reply. Lengths count code points. Turns are ordered by
    ``turn`` (null first), then role and text; rows that repeat a turn are all
    kept. Null text and null role count as empty; a null conv_id is a
    conversation. No rows give no rows; other columns are ignored.

    A conversation is streamed through a window in its order, never gathered."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    head = F.concat(F.lit(OPEN), escaped_role(F.col("role")), F.lit("\n"))
    body = escaped(F.col("text"))
    rows = rows.select("conv_id", "turn", "role", "text", head.alias("head"), body.alias("body"), (F.col("role") == TRAINED).alias("trainable"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        "conv_id",
        F.row_number().over(order).alias("position"),
        F.coalesce(F.sum(F.col("trainable").cast("long")).over(before), F.lit(0)).alias("example"),
        "trainable",
        "piece",
        F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)).alias("prefix_chars"),
        F.length("head").alias("loss_start"),
        (F.length("head") + F.when(F.col("trainable"), F.length("body")).otherwise(0)).alias("loss_end"),
    )


#: Characters of examples in a batch (a longer example is a batch of its own).
BATCH_CHARS = 1 << 21


def expanded(chains: DataFrame, max_chars: int | None = None, rest: bool = False) -> DataFrame:
    """Written-out examples: ``conv_id, example, trainable, text, loss_start, loss_end``, a row
    per assistant turn, with all turns before it as context; with ``rest``, also a row of
    the turns after the last assistant turn (``trainable`` false). With ``max_chars``
    the context starts at the first turn that leaves the example within so many
    characters (never less than its reply).

    The context is pieced together by position as the turns pass by, so a task holds one
    conversation's pieces and a batch of examples. This output has the square of a
    conversation's size where ``max_chars`` is None. Rows of a conversation follow each other, in order."""
    names = ["conv_id", "example", "trainable", "text", "loss_start", "loss_end"]
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key, begun, pieces, after, chars, held = None, False, [], 0, 0, 0

        def out() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [[]] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds, strict=True)], names)

        def finish() -> None:
            if rest and after < len(pieces):
                done.append((key, number, False, "".join(pieces[after:]), 0, 0))

        number = 0
        for batch in batches:
            for conv, example, trainable, piece, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "example", "trainable", "piece", "loss_start", "loss_end")), strict=True):
                if not begun or conv != key:
                    if begun:
                        finish()
                    begun, key, pieces, after, chars = True, conv, [], 0, 0
                pieces.append(piece)
                chars, number = chars + len(piece), example
                if trainable:
                    first, before = 0, chars - len(piece)
                    while max_chars is not None and first < len(pieces) - 1 and before + len(piece) > max_chars:
                        before -= len(pieces[first])
                        first += 1
                    text = "".join(pieces[first:])
                    done.append((conv, example, True, text, before + a, before + b))
                    after, number, held = len(pieces), example + 1, held + len(text)
                    if held >= BATCH_CHARS:
                        yield out()
                        held = 0
        if begun:
            finish()
        yield out()

    ordered = chains.select("conv_id", "position", "example", "trainable", "piece", "loss_start", "loss_end").repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "position")
    return ordered.mapInArrow(run, "conv_id long, example long, trainable boolean, text string, loss_start long, loss_end long")


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the texts of its examples (with the rest) and their loss spans
    alone: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    The turns of every example are read; those of the last one, and of the rest, are the
    conversation's. The replies are read by each example's own loss span.
    ``formatted_chars`` counts the characters of all examples, a turn in each that
    holds it, and of the rest."""
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, begun, done = None, False, []
        turns, rest, loss_chars, loss, chars = [], [], 0, hashlib.sha256(), 0

        def finish() -> None:
            whole = hashlib.sha256()
            for role, text in turns + rest:
                whole.update(f"{role}\n{text}\n".encode())
            done.append((key, len(turns) + len(rest), whole.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            cols = list(zip(*done, strict=True)) or [[]] * 6
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds, strict=True)], columns)

        for batch in batches:
            for conv, trainable, text, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "trainable", "text", "loss_start", "loss_end")), strict=True):
                if not begun or conv != key:
                    if begun:
                        finish()
                    begun, key = True, conv
                    turns, rest, loss_chars, loss, chars = [], [], 0, hashlib.sha256(), 0
                # no closing string is left in a role or text
                read = [parsed(piece) for piece in text.split(CLOSE)[:-1]]
                chars += len(text)
                if trainable:
                    turns, said = read, unescaped(text[a:b])
                    loss_chars += len(said)
                    loss.update(said.encode())
                else:
                    rest = read
            if done:
                yield out()
        if begun:
            finish()
            yield out()

    return examples.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_TURN = re.compile(r"((?:[^\\\n]|\\.)*)\n(.*)", re.S)


def parsed(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn, with its closing string or without."""
    role, text = _TURN.fullmatch(piece.removeprefix(OPEN).removesuffix(CLOSE)).groups()
    return unescaped(role), unescaped(text)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of one of control strings, read back from
    their formatted examples."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return read_back(expanded(format_conversations(rows.unionByName(added)), rest=True))


def _escaped_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace(replace(replace({c}, '\\', '\\\\'), '<|', '<\\|'), '\\[(/?INST\\])', '[\\\\\\1', 'g'), '<(/?s>)', '<\\\\\\1', 'g')"


#: The same rows for DuckDB, without the examples' texts: a turn counts in each that holds it.
OP6_SQL = f"""WITH t AS (SELECT CAST(conv_id AS BIGINT) AS c, CAST(turn AS BIGINT) AS n, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
p AS (SELECT *, {len(OPEN) + 1 + len(CLOSE)} + length(replace({_escaped_sql("r")}, chr(10), chr(92) || chr(10))) + length({_escaped_sql("x")}) AS chars FROM t),
q AS (SELECT *, sum(chars) OVER (PARTITION BY c ORDER BY n NULLS FIRST, r, x ROWS UNBOUNDED PRECEDING) AS upto,
  coalesce(sum(CASE WHEN r = '{TRAINED}' THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY n NULLS FIRST, r, x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS later FROM p)
SELECT c AS conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY n NULLS FIRST, r, x)) AS turns_sha256,
  CAST(coalesce(sum(length(x)) FILTER (r = '{TRAINED}'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(x, '' ORDER BY n NULLS FIRST, r, x) FILTER (r = '{TRAINED}'), '')) AS loss_sha256,
  CAST(coalesce(sum(upto) FILTER (r = '{TRAINED}'), 0) + coalesce(sum(chars) FILTER (later = 0), 0) AS BIGINT) AS formatted_chars FROM q GROUP BY c"""
