"""Line dedup against a brute-force deleter on random overlapping texts."""

import numpy as np
from geolark.llm import linededup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(line):
    return line.count(" ") + 1 if line else 0


def shared_runs(lines, least):
    """{(text, line)} of all common runs of at least `least` words that an earlier place has, for texts as lists of lines."""
    gone = set()
    for j, y in enumerate(lines):
        for i, x in enumerate(lines[: j + 1]):
            for shift in range(-len(x), len(y) + 1):  # y's line k beside x's line k - shift
                run = []
                for k in range(len(y) + 1):
                    at = k - shift
                    same = k < len(y) and 0 <= at < len(x) and x[at] == y[k] and (i < j or at < k)
                    if same:
                        run.append(k)
                        continue
                    if sum(words_of(y[q]) for q in run) >= least:
                        gone |= {(j, q) for q in run}
                    run = []
    return gone


def test_every_repeated_run_goes_and_nothing_else(spark):
    rng = np.random.default_rng(11)
    pool = [f"W{k} " + " ".join(f"w{rng.integers(10**6)}" for _ in range(int(rng.integers(3, 24)))) + " end." for k in range(40)]
    texts = []
    for n in range(40):
        lines, at = [], int(rng.integers(len(pool)))
        for _ in range(int(rng.integers(3, 14))):  # mostly runs of the pool, with jumps and lines of their own
            if rng.random() < 0.2:
                lines.append(f"Own {n} " + " ".join(f"o{rng.integers(10**9)}" for _ in range(int(rng.integers(2, 15)))) + ".")
            at = int(rng.integers(len(pool))) if rng.random() < 0.25 else (at + 1) % len(pool)
            lines.append(pool[at])
        texts.append(lines)
    texts += [list(texts[3]), list(texts[5])]
    frame = spark.createDataFrame([(i, " ".join(x), "en", "s", 0) for i, x in enumerate(texts)], DOCS)
    cut = [tuple(map(tuple, linededup.line_spans(" ".join(x)))) for x in texts]
    assert all(len(c) == len(x) for c, x in zip(cut, texts, strict=True))
    runs = {r.key: r.runs for r in linededup.repeated_runs(frame).collect()}
    keys = {r.doc_id: r.key for r in frame.select("doc_id", linededup.row_key("doc_id", "text").alias("key")).collect()}
    gone = {(i, q) for i, x in enumerate(texts) for a, b in ([] if keys[i] not in runs else [tuple(r) for r in runs[keys[i]]]) for q in range(a, min(b, len(x)))}
    must = shared_runs(texts, linededup.RUN_WORDS)
    may = shared_runs(texts, linededup.GRAM_WORDS) | {(i, q) for i in range(len(texts)) for q in range(len(texts[i])) if texts[i] in texts[:i]}
    assert must and must <= gone <= may


def test_three_texts_with_a_gram_of_an_earlier_one(spark):
    """The first text has one gram only, the next two share a long run around it: all of the run goes from the third."""
    rng = np.random.default_rng(12)
    line = lambda n: f"W{rng.integers(10**9)} " + " ".join(f"w{rng.integers(10**9)}" for _ in range(n - 2)) + " end."
    run = [line(n) for n in (10, 9, 21, 8, 12, 11)]
    texts = [" ".join([line(30), run[2], line(30)]), " ".join([line(15), *run, line(15)]), " ".join([line(14), *run, line(13)])]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.text for r in linededup.drop_repeated_lines(d).collect()}
    assert not any(x in got[2] for x in run) and all(x in got[1] for x in run[:2] + run[3:])


def test_very_popular_text_is_split(spark):
    """One early text that thousands of later ones repeat in part."""
    rng = np.random.default_rng(13)
    run = [" ".join([f"W{k}", *(f"w{rng.integers(10**9)}" for _ in range(11))]) + "." for k in range(5)]
    rows = [(i, " ".join([f"Start {i} of a text.", *run, f"End {i}."]), "en", "s", 0) for i in range(2500)]
    d = spark.createDataFrame(rows, DOCS).repartition(4)
    got = {r.doc_id: r.text for r in linededup.drop_repeated_lines(d).collect()}
    assert len(got) == 2500 and got[0] == rows[0][1] and all(got[i].strip() == f"Start {i} of a text. End {i}." for i in range(1, 2500))


def test_repeats_of_a_row_go_before_the_shuffle(spark, monkeypatch):
    import pyarrow as pa

    text = "One line that is long enough to count.\nAnother line that is long enough to count."
    batch = lambda keys: pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([f"{text} {k}" for k in keys])], names=["key", "text"])
    keys = lambda given: [k for b in linededup._details(iter(given)) for k in b.column(0).to_pylist()]
    assert keys([batch([7, 7, 8, 7]), batch([8, 9, 9]), batch([])]) == [7, 8, 9]
    monkeypatch.setattr(linededup, "SEEN", 1)
    assert keys([batch([7, 7, 8]), batch([8, 8, 9])]) == [7, 8, 8, 9]
    monkeypatch.undo()

    repeated = [(5, text, "en", "a", 1)] * 3000 + [(6, text, "en", "a", 1), (4, "Its own line, which nothing else repeats at all.", "en", "a", 1)]
    out = linededup.deduplicated(spark.createDataFrame(repeated, DOCS)).groupBy("doc_id", "text", "_deleted").count().collect()
    assert sorted((r.doc_id, r.text, r["count"]) for r in out) == [(4, repeated[-1][1], 1), (5, text, 3000), (6, "", 1)]


def deleted(spark, texts):
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    return {r.doc_id: r.text for r in linededup.deduplicated(frame).collect()}


def test_passages_without_sentence_ends(spark):
    """Passages of lower-case words, pasted into texts that have no borders either, lose most of their repeats; the texts around them stay."""
    rng = np.random.default_rng(13)
    words = lambda n: " ".join(f"w{rng.integers(10**7)}" for _ in range(n))
    groups = [(words(90), [words(int(rng.integers(15, 60))) for _ in range(6)]) for _ in range(8)]
    texts = [f"{a} {passage} {b}" for passage, around in groups for a, b in zip(around[:3], around[3:], strict=True)]
    got = deleted(spark, texts)
    gone = total = 0
    for g, (passage, around) in enumerate(groups):
        assert got[3 * g] == texts[3 * g]
        for i in (1, 2):
            left = set(got[3 * g + i].split())
            assert set(around[i].split()) | set(around[i + 3].split()) <= left
            gone += len(set(passage.split()) - left)
            total += 90
    print(f"of the words of repeated passages {gone / total:.2f} are deleted")
    assert gone >= 0.5 * total


def test_ideographic_sentences(spark):
    rng = np.random.default_rng(14)
    sentence = lambda n: "".join(chr(int(x)) for x in rng.integers(0x4E00, 0x9000, n)) + "。"
    passage = sentence(144)
    texts = [sentence(60) + passage + sentence(50), sentence(70) + passage + sentence(40)]
    got = deleted(spark, texts)
    assert got[0] == texts[0] and got[1] == texts[1].replace(passage, "")


def test_borders_depend_on_what_is_near():
    """The borders inside a stretch are the same wherever it stands, but for CUT_WORDS words at its ends."""
    rng = np.random.default_rng(15)
    words = lambda n: " ".join(f"w{rng.integers(10**7)}" for _ in range(n))
    stretch = words(200)
    inner = len(" ".join(stretch.split()[: linededup.CUT_WORDS + 1])), len(" ".join(stretch.split()[: -linededup.CUT_WORDS - 1]))
    seen = set()
    for before in ("", "A b. ", words(40) + " ", "x\n"):
        text = before + stretch + rng.choice(["", " End.", " " + words(30)])
        cuts = {int(c) - len(before) for c in linededup._cuts(linededup._points(text))}
        seen.add(tuple(sorted(c for c in cuts if inner[0] <= c <= inner[1])))
    assert len(seen) == 1 and len(next(iter(seen))) > 10
    joined = linededup.Lines.of_texts([stretch, stretch])[0]
    assert joined.begin[1] == len(linededup.line_spans(stretch)) and (joined.hashes[: joined.begin[1]] == joined.hashes[joined.begin[1] :]).all()


def test_texts_are_cut_together_as_alone():
    rng = np.random.default_rng(16)
    pieces = ["W a b. ", "x\n", "", "plain words " * 20, "漢字。", " ", "End", "\n"]
    texts = ["".join(rng.choice(pieces, int(rng.integers(0, 9)))) for _ in range(200)]
    runs = [sorted((int(a), int(a + rng.integers(1, 4))) for a in rng.integers(0, 6, int(rng.integers(0, 4)))) for _ in texts]
    assert linededup.cut_texts(texts, runs) == [linededup.cut_runs(t, r) for t, r in zip(texts, runs, strict=True)]
