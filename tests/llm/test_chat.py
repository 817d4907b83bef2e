"""Operator 6: the query reads written-out examples."""

from pyspark.sql import functions as F

from tessera.llm import chat
from tessera.llm.registry import queries

TURNS = "conv_id long, turn long, role string, text string"


def formatted(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def test_the_query_counts_each_turn_in_every_example(spark, tmp_path):
    rows = [(c, t, "assistant" if t % 2 else "user", f"turn {t} of {c} 😀") for c in (1, 2, 3) for t in range(3 + 2 * c)]
    rows += [(4, 0, "user", "alone"), (None, 0, "user", "a"), (None, 1, "assistant", "b")]
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries()["op6_chat_format"](spark, str(tmp_path)).collect()}
    for conv in (1, 2, 3, 4, None):
        text, chars, after = "", 0, ""
        for c, _, role, said in rows:
            if c == conv:
                text += formatted(role, said)
                after += formatted(role, said)
                if role == "assistant":
                    chars, after = chars + len(text), ""
        assert got[conv]["formatted_chars"] == chars + len(after)
        assert got[conv]["n_turns"] == sum(c == conv for c, *_ in rows)


def test_contexts_within_a_limit(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"{t}" * 10) for t in range(8)]
    pieces = [formatted(role, said) for _, _, role, said in rows]
    chains = chat.format_conversations(spark.createDataFrame(rows, TURNS))
    for limit in (1, 80, 120, 10_000):
        got = chat.expanded(chains, limit).orderBy(F.col("example")).collect()
        for k, r in enumerate(got):
            least = next(i for i in range(2 * k + 2) if len("".join(pieces[i : 2 * k + 2])) <= limit or i == 2 * k + 1)
            assert r["text"] == "".join(pieces[least : 2 * k + 2])
            assert r["text"][r["loss_start"] : r["loss_end"]] == f"{2 * k + 1}" * 10
