import hashlib

import pytest
from llm_support import PIECES, by_id, docs, llm  # noqa: F401

from shoal.llm.chat import AGAIN, CONTROL, TURN, Budget, escaped, format_conversations, read_back, turns_of, unescaped

SCHEMA = "conv_id long, turn int, role string, text string, extra string"


def digest(rows, role=None):
    return hashlib.sha256("".join(rows).encode()).hexdigest()


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = [r[3] or "" for r in own if r[2] == "assistant"]
        out[c] = (len(own), digest([f"{r[2] or ''}\n{r[3] or ''}\n" for r in own]), len("".join(loss)), digest(loss))
    return out


def got(table, budget):
    out = read_back(format_conversations(table, PIECES, budget)).collect()
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out}


def conversation(c, n, words=12):
    rows = [(c, 0, "system", f"be kind {c}", "x")]
    for i in range(1, n):
        rows.append((c, i, "user" if i % 2 else "assistant", f"turn {i} " + "wörd " * (i * 5 % words), "x"))
    return rows


@pytest.mark.parametrize("budget", [Budget(), Budget(60, 20, 60), Budget(40, 0, 200), Budget(10, 10, 10)])
def test_round_trip_at_any_budget(llm, budget):
    rows = conversation(1, 30) + conversation(2, 3) + conversation(None, 4) + [(3, 0, "assistant", None, "x"), (4, None, None, "q", "x")]
    rows += [(5, 1, "assistant", "same", "x")] * 3 + [(6, 0, "user", "".join(CONTROL) + "\\:\\", "x"), (6, 1, "assistant", "<<|end|>\\", "x")]
    rows += [(7, 0, "assistant", "long " * 4000, "x")]
    assert got(llm.createDataFrame(rows, SCHEMA), budget) == expected(rows)


def test_windows_fit_keep_the_system_turn_and_mask_repeats(llm):
    budget = Budget(80, 30, 160)
    rows = sorted(format_conversations(llm.createDataFrame(conversation(1, 60), SCHEMA), PIECES, budget).collect(), key=lambda r: r.first_turn)
    assert len(rows) > 5 and max(r.window_tokens for r in rows) <= 80
    assert all("be kind 1" in r.text for r in rows)
    assert rows[0].n_repeated == 0 and any(r.n_repeated > 1 for r in rows[1:])
    seen = []
    for r in rows:
        again = r.text.count(AGAIN)
        assert again == r.n_repeated and r.text.count(TURN) >= 1
        new, loss = turns_of(r.text, [(s["start"], s["end"]) for s in r.loss_spans])
        assert loss == [t for role, t in new if role == "assistant"]
        seen += new
    assert seen == [(r[2], r[3]) for r in conversation(1, 60)]


def test_escapes_are_reversible_and_leave_no_control_string():
    for text in ["".join(CONTROL), "</</s>s>", "\\", "\\:", "<\\:s>", "[IN[INST]ST]", *CONTROL]:
        assert unescaped(escaped(text)) == text
        assert not any(c in escaped(text) for c in CONTROL)


def test_empty_table(llm):
    assert read_back(format_conversations(llm.createDataFrame([], SCHEMA), PIECES)).collect() == []
