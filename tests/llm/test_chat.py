"""Chat windows: round trips, budgets and loss spans."""

from __future__ import annotations

import hashlib

import pytest

from stationlake.llm import chat

ROWS = "conv_id long, turn long, role string, text string, window string"


@pytest.mark.parametrize("text", ["", "plain", "<|im_end|>", "<\\|", "<\\\\|im_start|>", "a<<|b|>\n<|", "<", "\\<|"])
def test_escape_is_reversible(text):
    assert "<|" not in chat.escape(text)
    assert chat.unescape(chat.escape(text)) == text
    assert "\n" not in chat.escape_role(text)
    assert chat.unescape_role(chat.escape_role(text)) == text


def expected(turns):
    by = {}
    for conv, turn, role, text, _ in sorted(turns, key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, found in by.items():
        loss = "".join(t for r, t in found if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in found)
        out[conv] = (len(found), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_windows_read_back(corpus):
    turns = [(1, 0, "system", "be brief", "x")]
    turns += [(1, n, "assistant" if n % 2 == 0 else "user", f"<|im_end|> word {'w ' * (n * 3 % 50)}", "x") for n in range(1, 40)]
    turns += [(2, 0, "user", None, "x"), (2, 0, None, "tie", "x"), (2, 0, "user", None, "x"), (None, None, "assistant", "ok", "x")]
    turns += [(3, 0, "assistant", "long " * 500, "x"), (3, 1, "assistant", "", "x")]
    made = chat.windows(corpus.createDataFrame(turns, ROWS), budget=60, history=20)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(made).collect()}
    assert got == expected(turns)
    rows = made.where("conv_id = 1").orderBy("window").collect()
    assert len(rows) > 5
    for row in rows:
        shown = chat.read_window(row.formatted)
        assert shown[0] == ("system", "be brief")
        assert row.n_tokens <= 60 or row.n_turns == 2  # the system turn and one that fills the budget
        assert sum(chat.turn_tokens(text) for _, text in shown) == row.n_tokens
        assert len(row.loss_spans) == sum(role == "assistant" for role, _ in shown[row.n_repeated :])


def test_no_rows(corpus):
    assert chat.read_back(chat.windows(corpus.createDataFrame([], ROWS))).count() == 0
