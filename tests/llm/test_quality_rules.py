from collections import Counter

from llm_support import by_id, docs, llm  # noqa: F401

from shoal.llm.quality_rules import quality_verdicts, text_counts


def brute(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n\t ", "a b a b a b a", "é ü | $$ <x>\n\né ü | $$ <x>", "x\x1cy z", "one two three four one two three " * 30, "w" * 9000]


def test_counts_match_brute_force():
    for t in TEXTS:
        assert text_counts(t)[:5] == brute(t)


def test_verdicts(docs):
    clean = [" ".join(f"w{(i * 7 + j * j) % 997}" for j in range(80)) for i in range(60)]
    junk = " ".join(f"w{j}$$$" for j in range(80))
    rows = by_id(quality_verdicts(docs([*clean, junk, *TEXTS])), "base_failed", "kept")
    assert all(rows[i] == (False, True) for i in range(60))
    assert rows[60] == (False, False)
    assert all(rows[61 + k] == (True, False) for k in range(len(TEXTS)))


def test_small_groups_take_limits_of_their_language(llm):
    clean = " ".join(f"w{j}" for j in range(80))
    rows = [(i, clean + f" x{i}", "en", "big") for i in range(220)]
    rows += [(1000, clean.replace(" ", "| "), "en", "tiny"), (1001, clean, None, None)]
    out = by_id(quality_verdicts(llm.createDataFrame(rows, "doc_id long, text string, lang string, source string")), "kept")
    assert out[1000] is False and out[1001] is True and out[0] is True


def test_repeated_rows_and_empty_table(docs):
    assert quality_verdicts(docs(["a b"] * 3, [1, 1, 1])).count() == 3
    assert quality_verdicts(docs([])).collect() == []
