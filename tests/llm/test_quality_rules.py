"""The ledger against a plain count, policies, ablations and odd rows."""

import re

from quillon.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n\t", "one two", "a b c a b c", "same line\nsame line\n \nother", "x" * 5000, "Ümlaut ö # $ % 12 !? AB", " ".join(["word"] * 60), " ".join(f"w{k}" for k in range(70)), "lead joined and\x0bmore words\fhere", "\n".join(f"line {k % 3}" for k in range(40))]


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    again = {p + k for p, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    count = lambda chars: sum(c in chars for c in text)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": count("#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again), "n_lines": len(lines), "n_digits": count("0123456789"), "n_capitals": sum("A" <= c <= "Z" for c in text), "n_shouts": count("!?")}


def table(spark):
    rows = [(min(k, 10), t, 1, True, "x") for k, t in enumerate(TEXTS)] + [(9, TEXTS[9], 1, True, "x"), (None, "no id", 1, True, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept boolean, failed_mask string")


def failed(m):
    return sum(1 << r.bit for r in quality_rules.RULES if eval(r.fails.replace("=", "=="), {}, m))  # noqa: S307  the rules' own text


def test_ledger(spark):
    docs = table(spark)
    got = [r.asDict() for r in quality_rules.ledger(docs).collect()]
    wanted = [{"doc_id": r.doc_id, **measured(r.text), "failed_mask": failed(measured(r.text))} for r in docs.collect()]
    key = lambda r: repr(sorted(r.items(), key=lambda x: x[0]))
    assert sorted(map(key, got)) == sorted(map(key, wanted))
    assert quality_rules.ledger(docs.where("false")).count() == 0


def test_policies_and_ablations(spark):
    docs = table(spark)
    ledger = quality_rules.ledger(docs)
    masks = [r.failed_mask for r in ledger.collect()]
    for policy in quality_rules.POLICIES:
        whole = quality_rules.policy_mask(policy)
        assert sum(r.kept for r in quality_rules.apply_policy(ledger, policy).collect()) == sum(not m & whole for m in masks)
        wanted = {}
        for r in quality_rules.RULES:
            bit = 1 << r.bit
            if whole & bit:
                wanted[r.name] = (sum(bool(m & bit) for m in masks), sum(m & whole == bit for m in masks), sum(bool(m & whole & ~bit) for m in masks))
        assert {r.rule: (r.rejected, r.only_rule, r.without_rule) for r in quality_rules.ablations(ledger, policy).collect()} == wanted
    assert quality_rules.ablations(ledger.where("false"), "v1").count() == 0


def test_filter_keeps_whole_rows(spark):
    docs = table(spark)
    kept = quality_rules.filter_documents(docs, "base")
    assert kept.columns == docs.columns
    wanted = [tuple(r) for r in docs.collect() if not failed(measured(r.text)) & 3]
    assert sorted(map(repr, (tuple(r) for r in kept.collect()))) == sorted(map(repr, wanted)) and wanted
