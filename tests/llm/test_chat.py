import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.llm import chat

PARTS = st.lists(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "[ANS]", "[ROLE ", "[/ROLE]", "\\", "<\\/s>", "[\\\\INST]", "a", "\n", "]", "[", "<", "é"]), max_size=12).map("".join)
ROLES = st.sampled_from(["user", "assistant", "system", "", "odd]role\\", "tool\n"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(ROLES, PARTS), max_size=6))
def test_any_turns_come_back(turns):
    assert chat.parse_all(chat.BOS + "".join(chat.render(r, t) for r, t in turns)) == turns
    for _, t in turns:
        assert chat.unescape(chat.escape(t)) == t


def test_plain_texts_are_not_touched():
    assert chat.render("user", "hello \\ [1] <b>") == "[INST]hello \\ [1] <b>[/INST]"


def test_digests(spark, rows):
    data = [(1, 2, "assistant", "b</s>"), (1, 1, "user", None), (1, 1, "user", "a"), (None, 0, None, "x"), (2, None, "assistant", ""), (2, 0, "assistant", "é"), (2, 0, "assistant", "é")]
    df = spark.createDataFrame([(*r, "clash") for r in data], "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(df)).collect()}
    for conv in (1, 2, None):
        mine = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in data if c == conv))
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in mine)
        loss = "".join(x for _, _, r, x in mine if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(mine), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(chat.BOS) + sum(len(chat.render(role, x)) for _, _, role, x in mine)
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0
