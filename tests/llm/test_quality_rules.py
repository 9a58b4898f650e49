import re
from collections import Counter

from tarnframe.llm.quality_rules import RepetitionLimits, keep_unrepetitive, repetition_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, limits=RepetitionLimits()):
    text = text or ""
    words = WORD.findall(text)
    chars = sum(map(len, words))

    def inside(k):
        grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
        counts, flags = Counter(grams), [False] * len(words)
        for i, g in enumerate(grams):
            if counts[g] > 1:
                flags[i : i + k] = [True] * k
        return flags

    seen, n_dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                n_dup += 1
                dup_chars += sum(map(len, WORD.findall(line)))
            seen.add(line)
    out = {"n_words": len(words), "word_chars": chars, "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": n_dup, "n_repeat_words": sum(inside(3)), "dup_line_chars": dup_chars}
    for k, _ in limits.ngram_percent:
        out[f"dup_{k}gram_chars"] = sum(len(w) for w, f in zip(words, inside(k)) if f)
    out["base_failed"] = len(words) < 50 or 100 * out["n_repeat_words"] > 50 * len(words)
    out["kept"] = not out["base_failed"] and 100 * dup_chars <= limits.line_percent * chars and all(100 * out[f"dup_{k}gram_chars"] <= p * chars for k, p in limits.ngram_percent)
    return out


def test_counts_equal_brute_force(frame, awkward):
    texts = awkward + [(20, "a b c d e f g " * 9 + "h i j k l m n o p"), (21, "\n".join(["alpha beta gamma"] * 3 + ["delta"] * 2) + "\n\n")]
    found = sorted(repetition_rules(frame(texts)).toPandas().to_dict("records"), key=repr)
    expected = sorted(({"doc_id": i} | brute(t) for i, t in texts), key=repr)
    assert len(found) == len(texts)
    key = lambda r: tuple(str(r[k]) for k in sorted(r) if k != "doc_id")
    assert sorted(map(key, found)) == sorted(map(key, expected))


def between_own_words(phrases, n):
    """The phrases twice each, with words between them that occur once, ``n`` words in all."""
    twice, own = phrases * 2, (f"own{i:04}" for i in range(n))
    gap = (n - sum(map(len, twice))) // len(twice)
    words = [w for p in twice for w in [*p, *(next(own) for _ in range(gap))]]
    return " ".join(words + [next(own) for _ in range(n - len(words))])


def test_each_limit_rejects_what_the_base_rule_passes(frame):
    def phrase(k, at):
        return [f"rep{at}{i:03}" for i in range(k)]

    lines = "\n".join(f"repeated line\nown{i:04} words{i:04} of{i:04} this{i:04} line{i:04}" for i in range(12))
    texts = {
        "dup_4gram_chars": between_own_words([phrase(4, k) for k in range(3)], 70),
        "dup_6gram_chars": between_own_words([phrase(6, k) for k in range(2)], 83),
        "dup_10gram_chars": between_own_words([phrase(10, 0)], 80),
        "dup_line_chars": lines,
    }
    names = list(texts)
    found = {names[r.doc_id]: r for r in repetition_rules(frame(list(enumerate(texts.values())))).collect()}
    limits = RepetitionLimits()
    percents = {f"dup_{k}gram_chars": p for k, p in limits.ngram_percent} | {"dup_line_chars": limits.line_percent}
    for name, r in found.items():
        assert not r.base_failed and not r.kept, name
        assert [k for k, p in percents.items() if 100 * r[k] > p * r.word_chars] == [name]
    assert keep_unrepetitive(frame(list(enumerate(texts.values())))).collect() == []


def test_kept_rows_keep_their_columns(frame, awkward):
    docs = frame(awkward)
    kept = keep_unrepetitive(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t in awkward if brute(t)["kept"])


def test_empty_table(frame):
    assert repetition_rules(frame([])).collect() == []
    assert keep_unrepetitive(frame([])).collect() == []


def test_lines_of_two_letters_in_thue_morse_order_differ(frame):
    texts = []
    for size in (1024, 2048, 4096):
        bits = [bin(i).count("1") % 2 for i in range(size)]
        one, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
        texts += [one + "\n" + other, one + "\n" + other + "\n" + one, " ".join([one, "x y", other, "x y"] * 20)]
    found = {r.doc_id: r for r in repetition_rules(frame(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        expected = brute(text)
        assert {k: found[i][k] for k in expected} == expected
    assert [found[i].n_dup_lines for i in range(2)] == [0, 1]
