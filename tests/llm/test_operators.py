"""Each corpus operator against brute force, on the given tables and on awkward rows."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recfeat.llm import decontam, langid, licenses, mixing, neardup, pii, quality, queries, sharding, tokenfiles, toxicity

from . import brute


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(brute.odd_rows(), brute.SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def same(got, want):
    key = lambda row: tuple((x is not None, str(x)) for x in row)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_decontamination(spark, docs, odd, empty, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    same(decontam.contamination(docs, bench).collect(), brute.contamination(texts(docs), items))
    few = [(1, "Quick brown FOX"), (2, "fox"), (3, None), (None, "dog"), (4, ""), (5, " ".join(brute.odd_rows()[0][1].split()[3:15])), (5, "river bank")]
    made = spark.createDataFrame(few, "item_id long, text string")
    same(decontam.contamination(odd, made).collect(), brute.contamination(texts(odd), few))
    assert decontam.contamination(odd, made.limit(0)).filter("contaminated").count() == 0
    assert decontam.contamination(empty, made).count() == 0
    kept = {r.doc_id for r in decontam.decontaminate(odd, made).collect()}
    assert kept == {i for i, *_, bad in brute.contamination(texts(odd), few) if not bad} | {None}


def test_licenses(docs, odd, empty):
    for df in (docs, odd):
        rows = licenses.scan(df).collect()
        same([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows], [(i, *brute.licenses(t)) for i, t in texts(df)])
        want = []
        for i, t in texts(df):
            labels, n, best = brute.templates_matched(t, licenses.TEMPLATES, licenses.THRESHOLD, licenses.step_of)
            phrases = set(filter(None, brute.licenses(t)[4].split(",")))
            want.append((i, ",".join(sorted(labels | phrases)), n, 1.0 if phrases else round(best, 9)))
        same([(r.doc_id, r.labels, r.n_blocks, round(r.score, 9)) for r in rows], want)
    assert licenses.scan(empty).count() == 0


def test_license_texts(spark):
    """The commonest notices get their own label and no other, and whole texts are found inside other prose."""
    mit = next(t.text for t in licenses.TEMPLATES if t.label == "mit" and len(t.text.split()) > 150)
    prose = " ".join(f"p{i % 97}" for i in range(700)).split()
    gappy = " ".join(w for i, w in enumerate(mit.split()) if i % 12)
    rows = [
        ("licensed under CC BY 4.0", {"cc-by"}), ("This work is licensed under CC BY-NC 4.0.", {"cc-by", "cc-by-nc"}),
        ("It is licensed under a Creative Commons Attribution 4.0 International License", {"cc-by"}),
        ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", {"cc-by-sa"}),
        ("licensed under the Mozilla Public License Version 2.0", {"mpl-2.0"}), ("licensed under the Eclipse Public License, version 2.0", {"epl-2.0"}),
        ("Licensed under the Apache License, Version 2.0", {"apache-2.0"}),
        ("This work is licensed under the GNU Lesser General Public License, version 3", {"lgpl-notice"}),
        ("It is licensed under CC BY-NC-SA 4.0.", {"cc-by", "cc-by-nc-sa"}), ("licensed under CC BY-ND 4.0", {"cc-by", "cc-by-nd"}), ("Licensed under CC BY-NC-ND 4.0", {"cc-by", "cc-by-nc-nd"}),
        ("licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", {"cc-by-nc-sa"}),
        ("licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", {"cc-by-nd"}),
        ("You are free to share and adapt. This work is licensed under a Creative Commons Attribution 4.0 International License", {"cc-by"}),
        ("GNU Affero General Public License version 3", {"agpl"}),
        ("Text: licensed under CC BY-NC 4.0 " + " ".join(prose[:20]) + " pictures: licensed under CC BY-SA 4.0", {"cc-by", "cc-by-nc", "cc-by-sa"}),
        (" ".join(prose[:333]) + " " + mit.upper() + " " + " ".join(prose[333:]), {"mit"}), (" ".join(prose[:100]) + " " + gappy + " " + " ".join(prose), {"mit"}),
        (" ".join(mit.split()[:70]) + " " + " ".join(prose), {"mit"}), (" ".join(mit.split()[40:110]) + " " + " ".join(prose), set()),
    ]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()}
    want = {i: ",".join(sorted(x | ({"gpl"} if "General Public" in t else set()))) for i, (t, x) in enumerate(rows)}
    assert got == want
    long = (licenses.Template("long", " ".join(f"q{i}" for i in range(160))),)
    text = " ".join([*prose[:51], *(f"q{i}" for i in range(160) if i % 6), *prose])
    assert [r.labels for r in licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), long).collect()] == ["long"]


def test_quality(docs, odd, empty):
    for df in (docs, odd):
        rows = quality.repetition(df).collect()
        names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        same([[r[c] for c in names] for r in rows], [(i, *brute.quality(t)) for i, t in texts(df)])
        for n in (5, 7, 10):
            same([(r.doc_id, round(r[f"dup_{n}"], 9)) for r in rows], [(i, round(brute.dup_share(t, n), 9)) for i, t in texts(df)])
        assert not any(r.kept and r.base_failed for r in rows)
    assert quality.repetition(empty).count() == 0


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, odd, empty, size):
    rows = neardup.near_duplicates(docs, shingle=size).collect()
    want = brute.near(texts(docs), size)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    got = neardup.near_duplicates(odd, shingle=size).collect()
    assert len(got) == odd.count()
    by_id = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert (by_id[1], by_id[2], by_id[3], by_id[4], by_id[8]) == (1, 1, 1, 4, 8)
    assert neardup.near_duplicates(empty, shingle=size).count() == 0


def test_near_duplicate_chains_and_rings(spark):
    """Families whose members link only to their neighbours, and one whose members link to nothing."""
    base = [f"w{i}" for i in range(120)]
    chain = [(i, " ".join([*(f"c{j}" for j in range(i * 4)), *base[i * 4 :]])) for i in range(12)]
    loose = [(100 + i, " ".join(f"x{i}" if j % 8 == i % 8 else w for j, w in enumerate(f"v{k}" for k in range(200)))) for i in range(30)]
    rows = chain + loose
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near(rows, 2)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102)]
    got = dict(map(tuple, neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_token_files(spark, docs, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(50, " lead  two   three \n four\t five ", None, None, 1, 1), (51, "it's we'll  <|endoftext|>x  y", None, None, 1, 1), (52, "a <|endoftext|> b", None, None, 1, 1)], brute.SCHEMA)
    assert t.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]  # no switch is set
    for df in (docs, odd.unionByName(extra)):
        rows = sorted(texts(df), key=lambda r: (r[0] is not None, r[0] or 0))
        got = sorted(tokenfiles.token_files(df, path).collect(), key=lambda r: r.start)
        start = 0
        for (i, _), r in zip(rows, got, strict=True):
            assert (r.doc_id, r.start) == (i, start)
            start += r.n_tokens
        digest = lambda text: (n := [*t.encode(text or "", add_special_tokens=False).ids, 0]) and (len(n), brute.crc_of(n))
        same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], [(i, *digest(text)) for i, text in rows])
    assert tokenfiles.token_files(empty, path).count() == 0


def test_token_files_of_repeated_and_missing_ids(spark):
    """Hot ids spread over shards, each copy keeps a key of its own, and every row is read back."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [((None, 7, i)[i % 3], f"text {i % 400}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        places = tokenfiles.write_ids(df, path, tokenfiles.new_path(spark, "tokens")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len({r.shard for r in places if r.doc_id is None}) > 1
    assert sorted(r.copy for r in places if r.doc_id == 7) == list(range(300))
    got = tokenfiles.token_files(df, path).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == list(np.cumsum([0, *(r.n_tokens for r in order)])[:-1])


def test_perfect_hash():
    keys = tokenfiles.key_hash(np.arange(5000), np.zeros(5000, np.int64))
    perfect = tokenfiles.PerfectHash.load(tokenfiles.PerfectHash.build(keys).dump())
    assert sorted(perfect.slots(keys)) == list(range(5000))
    strange = perfect.slots(tokenfiles.key_hash(np.arange(10**6, 10**6 + 100), np.zeros(100, np.int64)))
    assert ((strange >= -1) & (strange < 5000)).all()


def test_sharding(docs, odd, empty):
    for df in (docs, odd):
        rows = sharding.shard_rows(df, 24).collect()
        want = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts(df)]
        same([(r.doc_id, r["size"], r.text_crc32) for r in rows], want)
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        counts = [len(slots[s]) for s in range(24)]
        assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(24))
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        order = sorted(rows, key=lambda r: (r.shard, r.slot))
        assert [r.curve for r in order] == sorted(r.curve for r in rows)
    assert sharding.shard_rows(empty, 24).count() == 0


def test_hilbert_curve(spark):
    """A walk along the curve visits every cell once and moves one step at a time."""
    cells = spark.range(512).select((F.col("id") % 8).alias("x"), (F.floor(F.col("id") / 8) % 8).alias("y"), F.floor(F.col("id") / 64).alias("z"))
    rows = cells.select("x", "y", "z", sharding.hilbert_index([F.col("x"), F.col("y"), F.col("z")], 3).alias("h")).collect()
    walk = [(r.x, r.y, r.z) for r in sorted(rows, key=lambda r: r.h)]
    assert sorted(r.h for r in rows) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(walk, walk[1:], strict=False))


def test_write_shards(odd, tmp_path):
    spark = odd.sparkSession
    manifest = sharding.write_shards(odd, str(tmp_path / "out"), 3)
    assert {r.shard: r.n_rows for r in manifest.collect()} == Counter(r.shard for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_readers_skip_shards(spark, sf_dir, tmp_path):
    """Of 24 shards a reader of one language and source needs few, and finds all its rows there."""
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    path = str(tmp_path / "out")
    manifest = sharding.write_shards(docs, path, 24)
    out = spark.read.parquet(path)
    need = []
    for r in docs.filter("lang is not null and source is not null").groupBy("lang", "source").count().orderBy("lang", "source").collect():
        shards = {x.shard for x in sharding.shards_with(manifest, r.lang, r.source).collect()}
        held = out.filter((F.col("lang") == r.lang) & (F.col("source") == r.source) & F.col("shard").isin(shards)).count() if shards else 0
        assert held == r["count"]
        need.append(len(shards))
    assert sum(need) / len(need) < 12
    big = {x.shard for x in sharding.shards_with(manifest, least_size=20_000).collect()}
    assert out.filter(F.octet_length("text") + 8 >= 20_000).filter(~F.col("shard").isin(big)).isEmpty() if big else True


def test_mixing(docs, odd, empty):
    for df, block in ((docs, 4), (odd, 2)):
        rows = mixing.mix(df, block=block).collect()
        assert Counter((r.doc_id, r.source) for r in rows) == Counter((r.doc_id, r.source) for r in df.collect())
        assert sorted(r.position for r in rows) == list(range(len(rows)))
        order = sorted(rows, key=lambda r: r.position)
        assert [r.slot for r in order] == sorted(r.slot for r in rows)
        assert len({(r.source, r.block) for r in rows}) == len({r.slot for r in rows})
        for s in {r.source for r in rows}:
            blocks = [r.block for r in order if r.source == s]
            assert blocks == sorted(blocks)
    assert mixing.mix(empty).count() == 0
    clashing = odd.withColumns({c: F.lit(1) for c in ("position", "slot", "block", "phase", "rank", "_at")})
    assert mixing.mixed(clashing).columns == clashing.columns and mixing.mixed(clashing).count() == odd.count()
    assert [r.doc_id for r in mixing.mixed(odd).collect()] == [r.doc_id for r in sorted(mixing.mix(odd).collect(), key=lambda r: r.position)]


def test_pfair_lag():
    """At every slot each source is less than one block from its share."""
    for parts in ([3, 7, 90], [500, 1, 1, 498], [1] * 10, [5, 5, 5, 85]):
        table, total = mixing.period_table(parts), sum(parts)
        assert sorted(x for t in table for x in t) == list(range(total))
        for a, slots in zip(parts, table, strict=True):
            assert list(slots) == sorted(slots)
            assert all(j * total / a - total / a < s + 1 and s < (j + 1) * total / a for j, s in enumerate(slots))
            done = np.cumsum(np.isin(np.arange(total), slots))
            assert (abs(done - a * np.arange(1, total + 1) / total) < 1).all()
    plan = mixing.phases({"a": 100, "b": 7, "c": 0, "d": 33}, {"a": 1, "b": 1, "d": 2})
    assert {s: sum(p["sources"].get(s, {"n": 0})["n"] for p in plan) for s in "abd"} == {"a": 100, "b": 7, "d": 33}


def test_pseudonyms(spark, docs, odd, empty):
    sample = [
        (1, "card 4111111111111111 or 4111-1111-1111-1111, not 4111111111111112; mail Ann.B.12@mail7.example.com ip 10.1.255.3 but 999.1.1.1"),
        (2, "call +1 (375) 555-4393 and (212) 555-0100, ssn 123-45-6789 not 000-12-3456, born 1980-02-29 not 1981-02-29, or 12/31/1999"),
        (3, "card 4111111111111111 mail ann.b.12@mail7.example.com"),
    ]
    df = spark.createDataFrame(sample, "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    assert (rows[1].n_card, rows[1].n_email, rows[1].n_ip, rows[2].n_phone, rows[2].n_ssn, rows[2].n_date) == (2, 1, 1, 2, 1, 2)
    one, two = rows[1].text, rows[2].text
    card = re.search(r"card (\d{16})", one)[1]
    spaced = re.search(r"or (\d{4})-(\d{4})-(\d{4})-(\d{4})", one)
    assert "".join(spaced.groups()) == card != "4111111111111111"
    assert sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(card))) % 10 == 0
    assert "not 4111111111111112" in one and "999.1.1.1" in one and "not 000-12-3456" in two and "not 1981-02-29" in two
    mail = re.search(r"mail ([a-z]{3}\.[a-z]\.\d{2}@mail7\.example\.com)", one)[1]
    assert rows[3].text == f"card {card} mail {mail}" and mail != "ann.b.12@mail7.example.com"
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4} and \(\d{3}\) \d{3}-\d{4}, ssn \d{3}-\d{2}-\d{4} not", two) and "375" not in two.split("and")[0]
    assert {r.doc_id: r.text for r in pii.pseudonymise(df, "other").collect()}[3] != rows[3].text
    for frame in (docs, odd):
        got = pii.pseudonymise(frame, "k").collect()
        assert len(got) == frame.count()
        plain = Counter(texts(frame))
        assert all((r.doc_id, r.text) in plain for r in got if not r.n_pii)
        want = []
        for i, t in texts(frame):
            text, n = brute.pseudonymise(t, "k", pii.PATTERNS, pii.ISSUERS)
            want.append((i, text, *(n[k] for k in pii.KINDS), sum(n.values())))
        same([(r.doc_id, r.text, *(r[f"n_{k}"] for k in pii.KINDS), r.n_pii) for r in got], want)
    assert any(r.n_pii for r in pii.pseudonymise(docs, "k").collect())
    assert pii.pseudonymise(empty, "k").count() == 0


def test_pseudonyms_by_kind(spark):
    """Every kind against brute force; what isn't valid stays; long mail names keep their format and stay apart."""
    name = "averylongmailboxnameofmorethantwentysixletters"
    sample = [
        f"{name}@x.org {name}s@x.org {name[:-1]}t.{'7' * 17}@x.org " + "9" * 40 + "a@x.org", "GB82 WEST 1234 5698 7654 32, DE89370400440532013000 and GB82 WEST 1234 5698 7654 33",
        "visa 4111 1111 1111 1111 time 1700000000003 1700000000004 1700000000005 other 9999999999999995 amex 378282246310005 long 4222222222222", "(017) 555-7713 +1 (974) 155-3436 201-555-0123 911.911.9111",
        "1.2.3.4 10.0.0.255 256.1.1.1", "001-01-0001 665-01-0001 667-99-9999 899-10-1000 900-10-1000 666-10-1000", "1900-01-01 2099-12-31 2100-01-01 02/29/2000 02/29/1900",
    ]
    df = spark.createDataFrame(list(enumerate(sample)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    for i, t in enumerate(sample):
        text, n = brute.pseudonymise(t, "k", pii.PATTERNS, pii.ISSUERS)
        assert got[i].text == text and {k: got[i][f"n_{k}"] for k in pii.KINDS} == {k: n[k] for k in pii.KINDS}
    mails = got[0].text.split()
    assert [len(x) for x in mails] == [len(x) for x in sample[0].split()] and len(set(mails)) == 4 and got[0].n_email == 4
    assert got[1].n_iban == 2 and got[1].text.endswith("GB82 WEST 1234 5698 7654 33") and all(x in got[2].text for x in ("1700000000003", "9999999999999995"))
    areas = [int(x) for x in re.findall(r"\(([0-9]{3})\)", got[3].text)]
    assert areas[0] < 200 <= areas[1]


def test_feistel_is_a_permutation(spark):
    out = spark.range(17 * 41).select(pii.feistel(F.floor(F.col("id") / 41), F.col("id") % 41, F.lit(17), F.lit(41), "k", "t").alias("x")).select("x.*").collect()
    assert len({(r.a, r.b) for r in out}) == 17 * 41 and all(0 <= r.a < 17 and 0 <= r.b < 41 for r in out)


def test_languages(spark, sf_dir, docs, odd, empty):
    rows = queries.op6_language_mixture(spark, sf_dir).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    judged = [r for r in rows if r.held_out and r.lang and r.lang_pred != "und"]
    assert len(judged) > 20 and sum(r.lang == r.lang_pred for r in judged) / len(judged) > 0.9
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out and 0 <= r.score <= 1 for r in rows)
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    got = langid.identify(odd, *model).collect()
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (4, 5, 6, 7)} == dict.fromkeys((4, 5, 6, 7), "und")
    assert len(got) == odd.count() and langid.identify(empty, *model).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, *langid.fit(empty)).collect()} == {"und"}
    assert {r.doc_id for r in langid.reject(odd, *model).collect()}.isdisjoint({4, 5, 6, 7})


def test_language_mixture(docs):
    langs, table = langid.fit(docs.select("doc_id", "text", "lang"))
    by = {r.lang: r.text for r in docs.filter("lang is not null and length(text) > 1500").collect()}
    two = sorted(by)[:2]
    data = np.frombuffer((by[two[0]][:1500] + " " + by[two[1]][:1500]).encode(), np.uint8)
    share = langid.mixture(langid._grams(data), table)
    assert {langs[i] for i in np.flatnonzero(share > 0.25)} == set(two)


def _brute_mixture(grams, table):
    """Forward selection that tries every language in each round, by long expectation-maximisation in doubles."""
    counts = Counter(grams.tolist())
    p, c = table[list(counts)].astype(np.float64), np.array(list(counts.values()), np.float64)

    def fit(langs):
        share = np.full(len(langs), 1 / len(langs))
        for _ in range(3000):
            share = share * ((c / (p[:, langs] @ share)) @ p[:, langs]) / c.sum()
        return c @ np.log(p[:, langs] @ share), share

    best = max((fit([k]) + ([k],) for k in range(table.shape[1])), key=lambda x: x[0])
    while len(best[2]) < table.shape[1]:
        more = max((fit([*best[2], k]) + ([*best[2], k],) for k in range(table.shape[1]) if k not in best[2]), key=lambda x: x[0])
        if more[0] - best[0] <= 3 * (0.5 * np.log(max(2.0, c.sum())) + 3.0):
            break
        best = more
    out = np.zeros(table.shape[1])
    out[best[2]] = best[1]
    return out


def test_mixtures_against_brute_force(docs):
    """Texts of one, two and three languages, one of them a hundredth of a long text, and short ones."""
    langs, table = langid.fit(docs.select("doc_id", "text", "lang"))
    by = {r.lang: r.text for r in docs.filter("lang is not null and length(text) > 2500").orderBy("doc_id").collect()}
    names = sorted(by)
    made = [by[x][:2000] for x in names] + [by[a][:900] + " " + by[b][:400] for a in names for b in names if a != b]
    made += [" ".join(by[x][:600] for x in names[:3]), by[names[0]] * 8 + " " + by[names[1]][:250], "a", "zu", "the", "der die das"]
    for text in made:
        data = np.frombuffer(text.encode(), np.uint8)
        got = langid._mixture_of(data, table)
        want = _brute_mixture(langid._grams(data if len(data) > 2 else np.frombuffer(b" " + text.encode() + b" ", np.uint8)), table)
        assert set(np.flatnonzero(got)) == set(np.flatnonzero(want)) and np.abs(got - want).max() < 0.03
    small = langid._mixture_of(np.frombuffer(made[-5].encode(), np.uint8), table)
    assert 0 < small[langs.index(names[1])] < 0.02 or len(by[names[0]]) < 2500


def test_toxicity(spark, odd, empty):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(1500):
        text = list(rng.choice(words, 60))
        bad = i % 8 == 0
        if bad:
            text[5], text[30] = ("vile", "nasty")[i % 2], "foul"
        rows.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, int(bad)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = toxicity.held_out()
    model = toxicity.fit(df.filter(~held), lab.filter(~held))
    got = [r for r in toxicity.score(df, *model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.predicted == 1) == (r.doc_id % 8 == 0) for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.score(odd, *model).count() == odd.count() and toxicity.score(empty, *model).count() == 0
    assert {r.predicted for r in toxicity.score(odd, *toxicity.fit(empty, lab)).collect()} == {0}
    # Labels of 0 are not needed: the prior comes from positives and unlabelled rows, or from the caller.
    for prior in (None, 0.125):
        model = toxicity.fit(df.filter(~held), lab.filter(~held).filter("toxic = 1"), prior=prior)
        got = [r for r in toxicity.score(df, *model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
        assert sum((r.predicted == 1) == (r.doc_id % 8 == 0) for r in got) / len(got) > 0.97
    tied = toxicity.score(spark.createDataFrame([(1, "foul vile"), (1, "foul vile"), (2, "vile foul")], "doc_id long, text string"), *model).collect()
    assert len(tied) == 3 and len({r.score for r in tied}) == 1


def _as_sample(pos, unl):
    halves = [np.arange(len(x)) % 2 for x in (pos, unl)]
    columns = np.arange(pos.shape[1])
    return toxicity.Sample(columns, columns, (columns, columns), pos, halves[0], unl, halves[1])


@pytest.mark.parametrize("share", [0.05, 0.15, 0.4])
def test_estimated_prior(share):
    """Within a quarter of the true share of positives among the unlabelled, for words of which none is sure."""
    rng = np.random.default_rng(11)
    rates = rng.uniform(0.02, 0.1, 200), np.concatenate((rng.uniform(0.15, 0.5, 25), rng.uniform(0.02, 0.1, 175)))
    toxic = rng.random(6000) < share
    unl = (rng.random((6000, 200)) < np.where(toxic[:, None], rates[1], rates[0])).astype(np.uint8)
    pos = (rng.random((800, 200)) < rates[1]).astype(np.uint8)
    assert abs(toxicity.estimate_prior(_as_sample(pos, unl)) / share - 1) < 1 / 4
    assert toxicity.estimate_prior(_as_sample(pos[:3], unl[:9])) == 0.5


@pytest.mark.parametrize("share", [0.06, 0.2, 0.4])
def test_prior_of_the_given_training_rows(spark, sf_dir, share):
    """Within 15 % for several shares of toxic documents, drawn from labelled training rows; half of the toxic ones are confirmed."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.1")
    held = toxicity.held_out()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(~held).select("doc_id", "text")
    one = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = [(zlib.crc32(b"draw%d" % r.doc_id) / 2**32, r.doc_id, r.toxic) for r in one.collect()]
    bad, good = (sum(t == k for _, _, t in rows) for k in (1, 0))
    keep = {1: min(1.0, share * good / (1 - share) / bad), 0: min(1.0, bad * (1 - share) / share / good)}
    drawn = [(i, t) for x, i, t in rows if x < keep[t]]
    known = [(i, 1) for i, t in drawn if t and zlib.crc32(b"known%d" % i) % 2]
    some = docs.join(spark.createDataFrame([(i,) for i, _ in drawn], "doc_id long"), "doc_id")
    got = toxicity.estimate_prior(toxicity.sample(some, spark.createDataFrame(known, "doc_id long, toxic int")))
    assert abs(got / (sum(t for _, t in drawn) / len(drawn)) - 1) < 0.15


def test_recall_on_a_fold_of_training_rows(spark, sf_dir):
    """Training rows kept apart: nine of ten toxic ones are found at 0.5, and few others are flagged."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet").filter(~toxicity.held_out()) for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    model = toxicity.fit(docs.filter(~fold), labels.filter(~fold))
    said = {r.doc_id: r.predicted for r in toxicity.score(docs.filter(fold), *model).collect()}
    found = Counter((r.toxic, said[r.doc_id]) for r in labels.filter(fold).collect())
    assert found[1, 1] / (found[1, 1] + found[1, 0]) >= 0.85 and found[0, 1] <= 0.02 * (found[0, 0] + found[0, 1])


def test_scores_against_plain_sums():
    """The score is the logistic of the bias and the weights of distinct words and of their beginnings of 4, 5 and 6 bytes."""
    texts_ = ["Foul vile FOUL", "", "été foulest, vileness vile-x", "a b c"]
    one = lambda word: toxicity._features(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0]
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts_)])
    idx, at = toxicity._features(np.frombuffer("".join(texts_).encode(), np.uint8), bounds)
    for k, t in enumerate(texts_):
        words = {w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))}
        want = set().union(*(set(one(w).tolist()) for w in words)) if words else set()
        assert set(idx[at[k] : at[k + 1]].tolist()) == want and at[k + 1] - at[k] == len(want)
        assert len(want) == len(words | {(w[:n], n) for w in words for n in toxicity.BEGINNINGS if len(w) > n})


def test_toxicity_of_the_given_tables(spark, sf_dir):
    """Held-out documents of the largest given tables (the small ones hold a handful of toxic ones): toxic ones score
    above the others."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.op10_toxicity(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts(docs))
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows)
    bad, good = ([r.score for r in rows if r.held_out and labels.get(r.doc_id) == k] for k in (1, 0))
    wins = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / max(1, len(bad) * len(good))
    assert wins > 0.95


def test_language_of_broken_bytes(spark, docs):
    """A text of bytes that aren't UTF-8 has no letters; beside letters they count like any other."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    rows = spark.createDataFrame([(1, bytearray(b"\xc3  ")), (2, bytearray(b"\xc3\xc3 the and of that"))], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    got = {r.doc_id: r.lang_pred for r in langid.identify(rows, *model).collect()}
    assert got[1] == "und" and got[2] != "und"
    assert langid.reject(rows.select("doc_id", "text"), *model).filter("doc_id = 1").count() == 0


def test_the_key_is_not_shown(spark, capsys):
    """Neither explain nor the plan that event logs hold has the key in it, whatever else the session hides."""
    df = spark.createDataFrame([(1, "mail ann@x.org")], "doc_id long, text string")
    out = pii.pseudonymise(df, "a (secret) key")
    out.explain("extended")
    assert "a (secret) key" not in capsys.readouterr().out and "secret" not in out._jdf.queryExecution().toString()
    assert "other key" not in pii.pseudonymise(df, "other key")._jdf.queryExecution().toString() and "secret" not in out._jdf.queryExecution().toString()
