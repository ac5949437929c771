from conftest import SF_DIR
from oracle_compare import compare, duck

from ridelake.llm import chat
from ridelake.llm.queries import QUERIES
from ridelake.llm.sql import CHAT_SQL

ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a\\b <x> [INST] \\s\\l"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "user", "tail"),
    (2, 0, "a\nb<", "no reply"), (3, None, None, None), (3, 0, "assistant", "é<turn|>\n<|turn>user\nx"), (None, 0, "assistant", "z"), (4, 0, "assistant", "z"),
    (4, 0, "assistant", "z"), (5, 0, "user", "q " * 40_000), (5, 1, "assistant", "w<" * 40_000),
]


def test_round_trip_with_nulls_ties_and_controls(spark):
    df = spark.createDataFrame([(*r, "f") for r in ROWS], "conv_id long, turn long, role string, text string, formatted string")
    convs = chat.format_conversations(df)
    parsed = {r.conv_id: [(t.role, t.text) for t in r.p] for r in convs.select("conv_id", chat.parse_turns(convs.formatted).alias("p")).collect()}
    for conv in {r[0] for r in ROWS}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in ROWS if c == conv))
        assert parsed[conv] == [t[2:] for t in turns]
    examples = chat.prefix_examples(convs).collect()
    for e in examples:
        if e.loss_start is not None:
            assert e.text.endswith(chat.CLOSE) and len(e.text) == e.loss_start + e.loss_chars + len(chat.CLOSE)
    assert sorted(e.example for e in examples if e.conv_id == 1) == [0, 1, 2]
    assert chat.conversation_digests(chat.prefix_examples(chat.format_conversations(df.limit(0)))).count() == 0
    digests = {r.conv_id: r for r in chat.conversation_digests(chat.prefix_examples(convs)).collect()}
    assert digests[1].loss_chars == len(ROWS[1][3]) and digests[2].loss_chars == 0 and digests[4].n_turns == 2


def test_query_matches_sql(spark):
    assert compare(QUERIES["op1_chat_prefix_targets"](spark, SF_DIR), duck(SF_DIR), CHAT_SQL) == []
