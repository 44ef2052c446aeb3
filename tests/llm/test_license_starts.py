"""A notice is found wherever enough of its words stand at their places."""

from evidentia.llm import license_scan


def test_an_altered_rare_word_loses_no_notice(spark):
    notice = "under the terms of the GNU General Public License as published by the FSF"
    texts = [notice + " and far away from here there is a foundation elsewhere"] + ["under the terms of the gnu general public license as published by free software"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in license_scan.summary(license_scan.scan(docs)).collect()}
    assert rows[0].labels == "gpl" and rows[0].score == 13 / 16


def test_a_word_put_in_left_out_or_replaced_anywhere(spark):
    grant = next(t for t in license_scan.TEMPLATES if t.label == "mit")
    words, key = [w.decode() for w in grant.words], grant.key.split()
    at = next(k for k in range(len(words)) if words[k : k + len(key)] == key)
    texts = []
    for k in range(len(words)):
        if not at < k < at + len(key):
            texts.append([*words[:k], "verily", *words[k:], "end"])
        if not at <= k < at + len(key):
            texts += [[*words[:k], *words[k + 1 :], words[k]], [*words[:k], "verily", *words[k + 1 :], "x", words[k]]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = license_scan.summary(license_scan.scan(docs)).collect()
    assert len(rows) == len(texts) and {r.labels for r in rows} == {"mit"}


def test_brute_force(spark):
    import random

    pick, rows = random.Random(5), []
    for i in range(300):
        words = [w.decode() for w in pick.choice(license_scan.TEMPLATES).words]
        for _ in range(pick.randrange(4)):
            k, other = pick.randrange(len(words)), pick.choice(["foundation", "other", "license"])
            words[k : k + pick.randrange(2)] = [other] * pick.randrange(2)  # put in, left out or replaced
        rows.append((i, " ".join(["license", "foundation", *words, "software", "the"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: {f.label: f.cover for f in r.found} for r in license_scan.scan(docs).collect()}
    for i, text in rows:
        have, want = text.split(), {}
        for t in (*license_scan.BASE, *license_scan.TEMPLATES):
            words, key = [w.decode() for w in t.words], license_scan.Template("", t.key, "").words
            off = 0 if t.cover == 1 else license_scan.SLACK
            for at in range(-len(words), len(have)):
                same = sum(any(0 <= at + k + d < len(have) and have[at + k + d] == w for d in range(-off, off + 1)) for k, w in enumerate(words))
                low, high = max(0, at - off), min(len(have), at + len(words) + off)
                near = any(have[k : k + len(key)] == [w.decode() for w in key] for k in range(low, high))
                if same / len(words) >= t.cover and near:
                    want[t.label] = max(want.get(t.label, 0), same / len(words))
        assert got[i] == want
