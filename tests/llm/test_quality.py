import re
from collections import Counter

from contingo.llm import quality
from tests.llm.conftest import CLASHES, EDGE_IDS, EDGE_TEXTS, prose


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i, g in enumerate(zip(words, words[1:], words[2:])) if tri[g] > 1 for j in range(3)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_counts_equal_brute_force(make_docs):
    texts = EDGE_TEXTS + [" ".join(prose(3, 60)) + " ### $$$ | <b>", "a b c a b c d", "AB CD! " * 60]
    got = quality.judge(make_docs(texts, range(len(texts)), **CLASHES), order=list(quality.RULES)).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert {k: r[k] for k in want} == want
        assert r.base_failed == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        assert not (r.base_failed and r.kept)


def test_cascade_keeps_what_judge_keeps_in_any_order(make_docs):
    docs = make_docs(EDGE_TEXTS, EDGE_IDS, **CLASHES)
    kept = sorted(str(r.text) for r in quality.judge(docs.select("doc_id", "text"), order=list(quality.RULES)[::-1])
                  .join(docs.select("doc_id", "text"), "doc_id").where("kept").select("text").distinct().collect())
    out = quality.cascade(docs)
    assert out.columns == docs.columns
    assert sorted({str(r.text) for r in out.collect()}) == kept
    assert sum(r.text == EDGE_TEXTS[5] for r in out.collect()) == 2        # repeated rows are judged one by one


def test_empty_table(make_docs):
    assert quality.judge(make_docs([])).count() == 0
    assert quality.cascade(make_docs([])).count() == 0


def test_order_is_rejections_per_cost():
    assert quality.order_rules({"a": (1.0, 0.1), "b": (0.1, 0.1), "c": (0.1, 0.0), "d": (0.01, 0.0)}) == ["b", "a", "d", "c"]
