"""Every known sentence and every rule of the licence scan."""

from __future__ import annotations

import random
import re

from lithic.llm import licences


def _scan(spark, texts):
    rows = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r.m for r in sorted(rows, key=lambda r: r.row.doc_id)]


def test_every_table_entry_is_found(spark):
    known = licences.sentence_table()
    names = {s: i for s, i in known.items() if i.endswith(".name")}
    got = _scan(spark, list(names))
    assert [m.ids for m in got] == [[i] for i in names.values()]
    assert [m.licences for m in _scan(spark, ["Released under MIT.", "Distributed\tunder GPL-3.0."])] == [["MIT"], ["GPL-3.0"]]


def test_every_rule_fires_on_its_own_sentences(spark):
    rules = [(n, [licences.SENTENCES[i] for i in r]) for n, _, r in licences.RULES if r[0] in licences.SENTENCES]
    got = _scan(spark, [" ".join(t) for _, t in rules] + ["\n".join(t) for _, t in rules] + [" ".join(t).replace(" of the", " of\nthe") for _, t in rules])
    for m, (name, _) in zip(got, rules * 3, strict=True):
        assert m.licences[0] == name  # shorter rules of the same text may follow


def test_both_readings_count(spark):
    grant, notice = (licences.SENTENCES[i].replace(" of ", " of\n") for i in ("mit.grant", "mit.notice"))
    lines = "\n".join(["Released under Apache-2.0", "Released under GPL-3.0", "Released under ISC", "Released under MPL-2.0"])
    (m,) = _scan(spark, [f"{grant}\n{notice}\n\n{lines}\nThe end"])
    assert set(m.licences) == {"MIT", "Apache-2.0", "GPL-3.0", "ISC", "MPL-2.0"}


def _plain(text: str) -> tuple[list[str], list[str]]:
    """Identifiers and licences of a text, by a loop over its sentences and rules."""
    known, parts = licences.known_parts()

    def read(t):
        t = re.sub(r"([Ii]dentifier):[ \t]+", r"\1 ", t)
        t = re.sub(r"\b([Vv])\.[ \t]+(?=\d)", r"\1 ", t)
        found = []
        for s in re.sub(r"([.!?;:])[ \t]+", "\\1\n", t).split("\n"):
            s = re.sub(" +", " ", re.sub("[^a-z0-9.+-]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), s)))
            s = re.sub(r"^[ .]+|[ .]+$", "", s)
            if s in known:
                found.append(known[s])
        return found

    def holds(rule, ids):
        left = iter(ids)
        return all(x in left for x in rule)

    by_line, joined = read(text), read(re.sub(r"[ \t]*\r?\n[ \t]*", " ", text))
    names = [n for n, _, r in licences.RULES if any(holds([x for i in r for x in parts.get(i, [i])], ids) for ids in (by_line, joined))]
    return (joined if len(joined) > len(by_line) else by_line), list(dict.fromkeys(names))


def test_against_a_plain_version(spark, tmp_path):
    """Random texts of known sentences, their parts and other words, in any order, cut and joined anyhow."""
    rng = random.Random(3)
    pieces = [*licences.SENTENCES.values(), *list(licences.sentence_table())[::9], "Some other sentence.", "no licence here", "", "All RIGHTS reserved!"]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", "\n", ". ", "\r\n", "; "]) for _ in range(rng.randint(0, 8))) for _ in range(300)] + ["", "word " * 100_000 + licences.SENTENCES["reserved"]]
    rows = [(i, t, "r", "m", "x") for i, t in enumerate(texts)] + [(None, None, None, None, None), (5, texts[5], "r", "m", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, m string, ids string")
    got = sorted((r.row.doc_id if r.row.doc_id is not None else -1, r.m.ids, r.m.licences, r.row.m) for r in licences.scan(df).collect())
    want = sorted((i if i is not None else -1, *_plain(t or ""), m) for i, t, _, m, _ in rows)
    assert got == want
    assert licences.scan(df.limit(0)).count() == 0
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = licences.op7_licence_scan(spark, str(tmp_path))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.sentence_ids, r.licences) for r in found.collect()) == [(i, ",".join(a), ",".join(b)) for i, a, b, _ in want]


def test_many_sentences_in_one_text(spark):
    """Long sequences that nearly hold a rule many times over."""
    line = "All rights reserved.\n"
    start = "\n".join(licences.SENTENCES[i] for i in ("bsd.grant", "bsd.source"))
    (m, n) = _scan(spark, [f"{start}\n{line * 50_000}", f"{start}\n{line * 20_000}{licences.SENTENCES['bsd.binary']}"])
    assert len(m.ids) > 50_000 and m.licences == ["All-rights-reserved"]
    assert n.licences == ["BSD-2-Clause", "All-rights-reserved"]
