import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from quillgrid.llm import chat_format

PIECES = ["<|start|>", "<|end|>\n", "<|message|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "|", "é", "漢", " ", "\n", "ok"]


@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_escape_is_reversible(text):
    e = chat_format.escape(text)
    assert chat_format.unescape(e) == text
    assert not any(c in e for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_round_trip(spark):
    rng = random.Random(8)
    rows = []
    for c in range(120):
        for t in range(rng.choice((1, 2, 5, 40))):
            rows.append((c, t, rng.choice(("user", "assistant", "system")), "".join(rng.choices(PIECES, k=rng.randint(0, 30)))))
    rows += [(500, 0, "assistant", None), (500, 0, None, "x"), (501, None, "assistant", "a"), (501, None, "assistant", "a"), (None, 1, "user", "q"), (None, 2, "assistant", "r")]
    rows += [(502, i, "assistant", f"turn {i}") for i in range(5000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int").repartition(5)
    got = {r.conv_id: r for r in chat_format.digest(chat_format.format_chats(df)).collect()}
    by = {}
    for r in sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) if not isinstance(x, str) else (True, x) for x in (r[1], r[2] or "", r[3] or ""))):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss)), c


def test_empty(spark):
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
