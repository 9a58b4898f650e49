import random

import numpy as np
import pyarrow as pa

from tarnframe.llm import toxicity as t
from tarnframe.llm.labelled import held_out, labelled_sample
from tarnframe.llm.textblocks import block_of, texts_of

from .conftest import PROSE

BAD = ["idiot", "stupid", "moron", "worthless", "scum", "loser"]


def corpus(n=400):
    rng = random.Random(3)
    words, out = PROSE.lower().replace(",", "").replace(".", "").split(), []
    for i in range(n):
        picked = [rng.choice(words) for _ in range(60)]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(4):
                picked[rng.randrange(60)] = rng.choice(BAD)
        out.append((i, " ".join(picked), int(toxic)))
    return out


def disguised(word):
    table = str.maketrans({"i": "1", "o": "0", "e": "3", "s": "$"})
    return [word.translate(table), " ".join(word), ".".join(word), word[:2] + word[1] * 3 + word[2:]]


def model_of(spark, frame, rows):
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    return t.train(frame([(i, x) for i, x, _ in rows]), labels)


def test_restores_and_scores(spark, frame):
    rows = corpus()
    model = model_of(spark, frame, rows)
    for word in BAD:
        restored = [model.characters.restore(x) for x in disguised(word)]
        assert sum(x == word for x in restored) >= 3, (word, restored)
    scored = {r.doc_id: r for r in t.score(frame([(i, x) for i, x, _ in rows]), model).collect()}
    held = [(scored[i].predicted, y) for i, _, y in rows if scored[i].held_out]
    assert len(held) > 40 and sum(p == y for p, y in held) >= 0.95 * len(held)
    hidden = [(1, PROSE + " you " + disguised("idiot")[0] + " and " + disguised("moron")[0] + " s t u p i d"), (2, PROSE)]
    a, b = sorted(t.score(frame(hidden), model).collect(), key=lambda r: r.doc_id)
    assert a.predicted == 1 and b.predicted == 0


def test_every_kind_of_disguise_counts(spark, frame):
    rows = [(i, x.replace("stupid", "kill").replace("moron", "ass"), y) for i, x, y in corpus()]
    model = model_of(spark, frame, rows)
    kinds = {
        "signs at the end": ["ki11", "a$$", "a55"],
        "a sign before punctuation": ["kil1,", "kil|.", "as5,"],
        "doubled letters": ["idiiot", "sscum", "iidiioott"],
        "one separator": ["id.iot", "sc-um", "lo_ser"],
        "few spaced letters": ["a s s", "a s s", "a s s"],
        "separators around spaced letters": ["k. i. l. l.", "s. c. u. m.", "i- d- i- o- t"],
        "plain": ["kill", "ass", "idiot!"],
    }
    texts = [" ".join([PROSE, a, "and the", b, "and the", c, "end"]) for a, b, c in kinds.values()]
    found = {r.doc_id: r for r in t.score(frame([*enumerate(texts), (99, PROSE)]), model).collect()}
    missed = [kind for i, kind in enumerate(kinds) if found[i].predicted != 1]
    assert missed == [] and found[99].predicted == 0


def test_plain_words_are_left_alone(spark, frame):
    model = model_of(spark, frame, corpus(60))
    for text in (PROSE, "the### and&&& of*** to%%%", "call 555-2355 on 12/03", "letter happened committee"):
        block = block_of(texts_of(pa.array([text])), 0, 1)
        starts, _ = t.suspicious_spans(block)
        assert len(starts) == 0, text
    restored = t.restore(frame([(1, PROSE), (2, None), (3, "an 1d10t")]), model.characters).collect()
    assert [r.text for r in restored][:2] == [PROSE, None]


def readings_by_enumeration(model, span):
    """Every reading of a span with its least cost."""
    closing = len(span.rstrip(t.CLOSING + t.SEPARATORS))
    paths = {(0.0, (0, 0), "", "")}
    for at, c in enumerate(span):
        thrice = span[max(at - 2, 0) : at + 1] == 3 * c or span[max(at - 1, 0) : at + 2] == 3 * c or span[at : at + 3] == 3 * c and at > 0 and span[at - 1] == c
        double = at > 0 and span[at - 1] == c
        repeats = c in t.LOOK_ALIKES and not (at >= closing and c in t.CLOSING) or double and c.isalpha()
        again = t.DOUBLE_COST if double and not thrice else t.REPEAT_COST
        new = set()
        for cost, (p, q), last, out in paths:
            for symbol, sign, price in t._readings(c, at >= closing):
                if symbol < 0:
                    new.add((cost + price, (p, q), last, out))
                elif symbol == 0 and q == 0:
                    new.add((cost + price, (p, q), "", out + sign))
                else:
                    new.add((cost + price + model.surprise[p, q, symbol], (q, symbol), sign, out + sign))
                if repeats and sign and sign == last:
                    new.add((cost + again, (p, q), last, out))
        paths = new
    least = {}
    for cost, (p, q), _, out in paths:
        least[out] = min(least.get(out, float("inf")), cost + (model.surprise[p, q, 0] if q else 0))
    return least


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(3):
        model = t.CharacterModel.of_counts(rng.integers(0, 50, 32**3))
        for span in ("1d0t", "a$$", "i.d", "sh1t", "p@3", "4b", "ki11", "kil|.", "s c u", "m0-r", "0o0n"):
            costs = readings_by_enumeration(model, span)
            best = min(costs.values())
            # a state keeps the last letter of its best path only, so a reading may cost a little more than the least
            assert costs[model.restore(span)] <= best + 1e-9, (span, model.restore(span), min(costs, key=costs.get))


def test_one_row_of_a_kind_gives_a_lexicon(spark, frame):
    rows = [(i, x, int(i == 9)) for i, x, y in corpus(90) if not y or i == 9]
    model = model_of(spark, frame, rows)
    assert model.lexicon.max() > 0
    texts = {i: x for i, x, _ in rows}
    scored = {r.doc_id: r.score for r in t.score(frame([(1, texts[9]), (2, PROSE), (3, None)]), model).collect()}
    assert scored[1] > scored[2] == scored[3]


def test_the_sample_has_one_row_an_id(spark, frame):
    rows = corpus(60)
    pairs = [(i % 7 if y else i, x) for i, x, y in rows] + [(i, x) for i, x, _ in rows for _ in range(3)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    sample = labelled_sample(frame(pairs), labels, "doc_id", "text", "toxic", held_out("doc_id", 5, 0), 20).collect()
    assert len(sample) == 20 == len({r.doc_id for r in sample})
    assert all(r._text == min(x for i, x in pairs if i == r.doc_id) for r in sample)
    one = t.train(frame(pairs), labels, max_rows=20)
    other = t.train(frame(pairs).repartition(7), labels, max_rows=20)
    assert (one.lexicon == other.lexicon).all() and np.allclose(one.coefficients, other.coefficients)


def test_a_shared_header_costs_no_label(spark, frame):
    header = "this page was printed for you by the office "
    rows = [(i, header + x, y) for i, x, y in corpus(90)]
    model = model_of(spark, frame, rows)
    scored = {r.doc_id: r.predicted for r in t.score(frame([(i, x) for i, x, _ in rows]), model).collect()}
    assert sum(scored[i] == y for i, _, y in rows) >= 0.95 * len(rows)


def test_awkward_rows(spark, frame, awkward):
    model = model_of(spark, frame, corpus(120))
    rows = t.score(frame(awkward), model).collect()
    assert len(rows) == len(awkward) and all(0 <= r.score <= 1 for r in rows)
    by_text = {r.doc_id: r.score for r in rows}
    assert by_text[0] == by_text[1] == by_text[2]
    assert t.score(frame([]), model).collect() == []


def test_no_labels(spark, frame, awkward):
    model = t.train(frame(awkward), spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.predicted == 0 for r in t.score(frame(awkward), model).collect())
    t.train(frame([]), spark.createDataFrame([], "doc_id long, toxic int"))
