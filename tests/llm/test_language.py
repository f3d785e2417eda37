import random
from zlib import crc32

import numpy as np

from tracewright.llm import language


def corpus():
    rng, rows = random.Random(6), []
    stems = {"aa": ["thing", "tion", "with"], "bb": ["schön", "heit", "ung"], "cc": ["ción", "ñar", "que"]}
    for i in range(240):
        lang = rng.choice(sorted(stems))
        word = lambda: "".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3)))  # noqa: B023, E731
        rows.append((i, " ".join(word() for _ in range(rng.randint(3, 30))).capitalize() + ".", lang))
    return rows


def plain_scores(text, model):
    """Word by word with dictionaries."""
    out = np.array(model.prior, dtype=float)
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        tables = [dict(zip(h.tolist(), logs, strict=True)) for h, logs in model.tables]
        codes = np.array([ord(c) for c in word], dtype=np.uint32)
        whole = language.span_hashes(language.running_hash(codes), np.array([0]), np.array([len(codes)]))[0]
        if int(whole) in tables[0]:
            out += tables[0][int(whole)]
            continue
        marked = np.array([0x110000, *codes, 0x110000], dtype=np.uint32)
        for n in range(len(tables) - 1, 0, -1):
            starts = np.arange(max(0, len(marked) - n + 1))
            grams = language._salted(language.span_hashes(language.running_hash(marked), starts, starts + n), n) if len(starts) else []
            known = [tables[n][int(g)] for g in grams if int(g) in tables[n]]
            if known:
                out += np.mean(known, axis=0)
                break
    return out


def test_scores_equal_plain_version(spark, documents):
    model = language.learn(documents(corpus()), longest=4)
    texts = ["Thingtion with", "schönheitungung xyz", "", "123 !", "ÑARQUE quecióncioncion", "q", "İstanbul ſ ǅ"]
    letters, logs = language.log_scores(texts, model)
    assert letters.tolist() == [True, True, False, False, True, True, True]
    for row, text in enumerate(texts):
        assert np.allclose(logs[row], plain_scores(text, model), atol=1e-4)


def test_held_out_accuracy_and_edges(spark, documents):
    rows = corpus()
    docs = documents([*rows, (900, None, None), (901, "", None), (902, "12 ²③ !", None), (None, "schönheit", None), (903, "thing " * 30_000, None), rows[0], (904, "with", None)])
    found = language.report(docs).collect()
    assert len(found) == len(rows) + 7
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (900, 901, 902))
    assert by_id[None].lang_pred == "bb" and by_id[None].held_out is False
    assert by_id[903].lang_pred == "aa"
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert all((crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_nothing_learned_and_no_rows(spark, documents):
    assert [(r.lang_pred, r.score) for r in language.report(documents([(1, "some words", None)])).collect()] == [("und", 0.0)]
    assert language.report(documents([])).count() == 0


def test_columns_of_other_meaning_do_not_clash(spark, documents):
    docs = documents(corpus())
    plain = sorted(map(tuple, language.report(docs).collect()))
    clashing = docs.selectExpr("*", "1 AS share", "2 AS language", "3 AS n", "4 AS hash", "5 AS count", "6 AS score")
    assert sorted(map(tuple, language.report(clashing).collect())) == plain
