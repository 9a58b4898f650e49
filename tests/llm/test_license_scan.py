import re

from pyspark.sql import functions as F

from tarnframe.llm.license_scan import TEMPLATES, bands_needed, plain_words, scan_licenses, template_of

from .conftest import PROSE


def brute(pairs, containment=0.8):
    out = set()
    templates = [template_of(n, t) for n, t in TEMPLATES.items()]
    for i, text in pairs:
        words = plain_words(text or "")
        runs = [" ".join(words[a : a + 5]) for a in range(len(words) - 4)]
        for t in templates:
            best = max((len(set(runs[a : a + t.width]) & set(t.shingles)) for a in range(0, max(len(runs), 1), t.width // 2)), default=0)
            if best >= -(-containment * len(t.shingles) // 1):
                out.add((i, t.name, best))
    return out


def found(df):
    return {(r.doc_id, r.license, r.found_shingles) for r in df.collect()}


def test_equals_brute_force(frame, awkward):
    cases = list(awkward)
    for k, (name, text) in enumerate(TEMPLATES.items()):
        cases += [(100 + k, PROSE + "\n" + text + "\n" + PROSE), (200 + k, text), (300 + k, PROSE + re.sub(r"\s+", "\n * ", text).upper() + PROSE)]
        words = text.split()
        cases.append((400 + k, PROSE + " ".join(words[: len(words) // 2])))
        cases.append((500 + k, " ".join(w for j, w in enumerate(words) if j != len(words) - 2) + " " + PROSE))
    cases += [(100, "Released under the MIT License.")] * 2
    assert found(scan_licenses(frame(cases))) == brute([c for c in cases if c[0] != 100] + [(100, cases[len(awkward)][1] + "\n" + "Released under the MIT License.")])


def test_every_template_is_found_whole(frame):
    rows = found(scan_licenses(frame([(k, t) for k, t in enumerate(TEMPLATES.values())])))
    assert {(k, n) for k, n, _ in rows} >= set(enumerate(TEMPLATES))


def test_empty_and_bands(frame):
    assert scan_licenses(frame([])).collect() == []
    known = [template_of(n, t) for n, t in TEMPLATES.items()]
    assert bands_needed(known, 0.8, 0.999) > bands_needed(known, 0.8, 0.9) >= 1


def test_long_texts_in_pieces(frame, monkeypatch):
    words = [f"{w}{k % 7}" for k in range(90) for w in PROSE.split()]
    texts = []
    for at in range(3900, 4300, 9):
        notice = list(TEMPLATES.values())[at % len(TEMPLATES)]
        texts.append((at, " ".join(words[:at] + [notice] + words[at:5000] + [notice + "."] + words[5000:])))
    assert found(scan_licenses(frame(texts))) == brute(texts)


def test_a_text_of_64_mb(spark, tmp_path):
    notice = TEMPLATES["mit-permission"]
    filler = F.repeat(F.lit("the river moves slowly past the old mill and children "), 10_000)
    text = F.repeat(F.concat(filler, F.lit(notice + "\n"), F.col("id").cast("string")), 130)
    spark.range(1).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(f"{tmp_path}/long")  # no constant of the plan
    docs = spark.read.parquet(f"{tmp_path}/long")
    assert docs.select(F.octet_length("text")).first()[0] > 64 << 20
    assert found(scan_licenses(docs)) == {(0, "mit-permission", len(template_of("x", notice).shingles))}


def test_main_path_is_native(frame):
    plan = scan_licenses(frame([(1, PROSE)]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
