"""The corpus operators against brute force, and on odd rows."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweft.llm import (
    components, html_text, langid, licenses, mixing, packing, quality, queries, sharding, simhash, surrogates, vector_dedup,
)

from test_near_copies import brute_kept

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, `odd.name` string"
LONG = "a long text of words " * 5000


def odd_rows(spark):
    rows = [
        (1, None, None, None, None, 9, "x", "y"), (2, "", "en", "s", 0, 9, "x", "y"), (3, LONG, "en", "s", 1, 9, "x", None),
        (4, "same words here", "fr", "t", 1, None, None, None), (4, "same words here", "fr", "t", 1, None, None, None),
        (None, "   \n\t ", None, "t", 1, None, None, None), (5, "mail a.b1@c.example now", "en", None, 1, 1, "x", "y"),
        (6, "你好 123 😀".encode("utf-16", "surrogatepass").decode("utf-16"), "zz", "s", 1, 1, "x", "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark)


def test_shards_are_even_gapless_and_mixed(spark, docs):
    rows = queries.op1_sharding(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    for r in rows:
        raw = docs[r["doc_id"]]["text"].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))


def test_shards_of_blocks_and_odd_rows(spark):
    rows = sharding.shuffle_shards(spark.range(1000).repartition(5), 3, block_rows=50).collect()
    for shard, n in enumerate((334, 333, 333)):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    odd = sharding.shuffle_shards(odd_rows(spark), 3)
    assert odd.count() == 8 and dict(odd.dtypes)["shard"] == "int" and "odd.name" in odd.columns
    assert sharding.shuffle_shards(odd_rows(spark).limit(0), 3).count() == 0


def test_communication_matrix_has_its_margins():
    for total in (10_000, 3 * 10**9):
        rows, sizes = sharding.even_sizes(total, 7), sharding.even_sizes(total, 5)
        matrix = sharding.communication_matrix(rows, sizes, 3)
        assert matrix.sum(axis=1).tolist() == rows and matrix.sum(axis=0).tolist() == sizes and (matrix >= 0).all()
        assert abs(matrix / (total / 35) - 1).max() < 0.2


def test_language_of_held_out_texts(spark, docs):
    rows = queries.op2_language_id(spark, SF).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_spans_and_odd_rows(spark, docs):
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    one = {lang: next(r["text"] for r in docs.values() if r["lang"] == lang and 300 < len(r["text"]) < 9000) for lang in ("en", "fr")}
    (lang, _, spans), = langid.label_texts([one["en"] + " " + one["fr"] * 3], model.value)
    assert lang == "fr" and [s[2] for s in spans] == ["en", "fr"] and abs(spans[1][0] - len(one["en"])) < 40
    rows = langid.identify(odd_rows(spark), model).collect()
    assert {r["lang_pred"] for r in rows if not r["text"] or not r["text"].strip()} == {"und"}
    assert [r["lang_pred"] for r in rows if r["doc_id"] == 6][0] in model.value.languages
    assert {r["lang_pred"] for r in langid.identify(odd_rows(spark), langid.train(odd_rows(spark).limit(0))).collect()} == {"und"}


def brute_vectors(ids, rows, least=0.98):
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    adjacent = unit @ unit.T >= least
    np.fill_diagonal(adjacent, False)
    group = np.array(ids)
    while True:
        new = np.minimum(group, np.where(adjacent, group[None, :], 1 << 60).min(axis=1))
        if (new == group).all():
            return {k: (int(adjacent[i].sum()), int(group[i]), bool(group[i] == k)) for i, k in enumerate(ids)}
        group = new


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = np.concatenate([c + rng.normal(scale=s, size=(60, 8)) for c, s in zip(centres, [0.02, 0.1, 0.2, 0.3] * 3, strict=True)])
    rows = np.concatenate([rows, rows[:40]]).astype(np.float32).astype(np.float64)
    frame = spark.createDataFrame([(i, r.tolist(), 1) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    found = vector_dedup.near_vectors(frame, cell_rows=40).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found} == brute_vectors(list(range(len(rows))), rows)


def test_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(6)
    rows = rng.normal(size=8) + rng.normal(scale=0.12, size=(90, 8))
    frame = spark.createDataFrame([(i, r.tolist(), 1) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    found = vector_dedup.near_vectors(frame).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found} == brute_vectors(list(range(90)), rows)


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1),
        (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [1.0, 0.0], 2), (10, [1.0], 1), (10, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (11, [], 1),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = vector_dedup.near_vectors(frame).collect()
    links = {(r["vec_id"], r["n_links"], r["component_id"]) for r in found}
    assert len(found) == len(rows) and {(1, 3, 1), (2, 3, 1), (10, 3, 1), (None, 3, 1), (10, 0, 10)} <= links
    assert {r["vec_id"] for r in found if r["n_links"] == 0} == {3, 4, 5, 6, 7, 8, 9, 10, 11}
    assert vector_dedup.near_vectors(frame.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)}


def brute_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    counts = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked, seen, dups = set(), set(), 0
    for i in range(len(words) - 7):
        if counts[tuple(words[i : i + 8])] > 1:
            marked.update(range(i, i + 8))
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(marked)


def test_quality_against_brute_force(spark, docs):
    rows = queries.op4_quality_rules(spark, SF).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in rows:
        stats = brute_statistics(docs[r["doc_id"]]["text"])
        assert tuple(r[n] for n in quality.STATISTICS) == stats
        assert r["base_failed"] == (stats[0] < 20 or 100 * stats[4] > 30 * stats[0]) and not (r["base_failed"] and r["kept"])
    good = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2


def test_quality_of_odd_rows(spark):
    rows = quality.quality_rules(odd_rows(spark)).collect()
    assert len(rows) == 8 and not any(r["kept"] for r in rows)
    long = next(r for r in rows if r["doc_id"] == 3)
    assert long["n_words"] == 25000 and long["n_repeat_words"] == 25000
    assert quality.quality_rules(odd_rows(spark).limit(0)).count() == 0
    assert quality.good_documents(odd_rows(spark)).columns == odd_rows(spark).columns


def brute_fingerprint(text):
    import xxhash

    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark, docs):
    rows = {r["doc_id"]: r for r in queries.op5_simhash(spark, SF).collect()}
    prints = {d: brute_fingerprint(r["text"]) for d, r in docs.items()}
    assert {d: r["fingerprint"] for d, r in rows.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    group = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            least = min(group[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 2)
            changed |= least < group[a]
            group[a] = min(group[a], least)
    assert {d: r["component_id"] for d, r in rows.items()} == group


def test_all_close_fingerprints_are_found(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63, 40).tolist()
    near = set(base)
    for value in base:
        for _ in range(6):
            flips = rng.choice(64, rng.integers(1, 4), replace=False)
            near.add(int(np.array([(value & (2**64 - 1)) ^ sum(1 << int(f) for f in flips)], dtype=np.uint64).view(np.int64)[0]))
    values = sorted(near)
    wanted = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    found = simhash.linked_fingerprints(spark.createDataFrame([(v,) for v in values], "fp long")).collect()
    assert len(found) == len(wanted) and {tuple(r) for r in found} == wanted


def test_simhash_of_odd_rows(spark):
    rows = simhash.simhash_groups(odd_rows(spark), carry=["odd.name"]).collect()
    zero = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert len(rows) == 8 and {r["doc_id"] for r in zero} == {1, 2, None} and {r["component_id"] for r in zero} == {1}
    kept = simhash.without_copies(odd_rows(spark)).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3, 4, 5, 6]
    assert simhash.without_copies(odd_rows(spark).limit(0)).count() == 0


def test_license_cosine_and_inheritance(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.txt", "plain words"), (3, "a/b/c/y.txt", None),
        (4, "d/z.txt", "words\nLicensed under CC BY-NC 4.0.\nmore words"), (5, "d/e.txt", "nothing"), (6, None, "nothing"), (7, "a/b/COPYING", "Licensed under the Apache License, Version 2.0."),
        (8, "top.txt", ""), (8, "top.txt", ""),
    ]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, at string, text string"), F.col("at")).collect()
    got = sorted(((r["doc_id"], r["license"], r["evidence"], r["origin"]) for r in found), key=str)
    wanted = [
        (1, "MIT", "file", None), (2, "Apache-2.0", "inherited", "a/b"), (3, "Apache-2.0", "inherited", "a/b"),
        (4, "CC-BY-NC-4.0", "header", None), (5, None, "none", None), (6, None, "none", None), (7, "Apache-2.0", "file", None),
        (8, None, "none", None), (8, None, "none", None),
    ]
    assert got == sorted(wanted, key=str)
    assert licenses.scan_licenses(odd_rows(spark), F.col("source")).count() == 8


def test_license_lines_against_brute_force(spark, docs):
    model = licenses.Model()

    def cosine(text):
        counts = Counter(licenses.terms(text))
        weights = {t: n * model.idf.get(t, model.unseen) for t, n in counts.items()}
        length = sum(w * w for w in weights.values()) ** 0.5
        return max((round(sum(w * v.get(t, 0) for t, w in weights.items()) / length, 9), -i) for i, v in enumerate(model.vectors)) if length else (0, 0)

    rows = {r["doc_id"]: r for r in queries.op6_license_scan(spark, SF).collect()}
    for d, r in docs.items():
        best = max(cosine(p) for p in [*r["text"].split("\n"), *re.split(r"\n[^A-Za-z0-9\n]*\n", r["text"]), r["text"]])
        if best[0] >= model.least:
            assert rows[d]["license"] == model.names[-best[1]] and rows[d]["cosine"] == pytest.approx(best[0], abs=1e-8)
        else:
            assert rows[d]["cosine"] is None


def test_mix_reaches_its_targets(spark, docs):
    rows = queries.op7_mixing(spark, SF).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        source = docs[r["doc_id"]]["source"]
        assert r["size"] == len(WORD.findall(docs[r["doc_id"]]["text"])) and r["taken"] <= 3 * r["size"]
        sizes[source] += r["size"]
        taken[source] += r["taken"]
        target[source] = r["target"]
    assert all(r["source_size"] == sizes[docs[r["doc_id"]]["source"]] for r in rows)
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes) and sum(target.values()) == pytest.approx(sum(sizes.values()))
    assert sorted(map(str, rows)) == sorted(map(str, queries.op7_mixing(spark, SF).collect()))
    places = [r["position"] for r in rows if r["position"] is not None]
    assert places == sorted(places)


def test_mix_caps_and_odd_rows(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(10, "a"), (90, "b"), (900, "c"), (5, None), (0, "d")])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["source"]: r for r in mixing.mix(frame, mixing.word_count(F.col("text"))).collect()}
    assert {s: found[s]["taken"] for s in ("a", "b", "d", None)} == {"a": 30, "b": 270, "d": 0, None: 15}
    assert found["c"]["target"] == 1005 - 30 - 270 - 15
    assert mixing.mixed_documents(frame).count() == 3 + 3 + 1 + 3
    odd = mixing.mix(odd_rows(spark), mixing.word_count(F.col("text")))
    assert odd.count() == 8 and mixing.mixed_documents(odd_rows(spark)).columns == odd_rows(spark).columns
    assert mixing.mix(odd_rows(spark).limit(0), F.lit(1).cast("long")).count() == 0


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("only text", "only text"), ("<p>", ""), ("<script>x</script>", ""),
        ("<body><nav>menu</nav><article><h1>T</h1><p>a &amp; b<br>c<p>d\n e</article><footer>f</footer>", "T\na & b c\nd e"),
        ("<div class='sidebar'>s</div><div class='content'><h2>H</h2><p>One, two.</p><ul><li>x<li>y</ul></div><form>f</form>", "H\nOne, two.\nx\ny"),
        ("<main><p>a</p><section id='comments'><p>no, no, no</p></section><div class='ad'>no</div></main>", "a"),
        ("<table><tr><td>one<td>two</table>", "one\ntwo"), ("<div class='has-sidebar'><p>kept &lt;b&gt;</p></div>", "kept <b>"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_pages(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = queries.op8_html_text(spark, SF).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(found) == pages.count()
    for r in found:
        article = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", " " if "<br>" in b else "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def check_packing(rows, ids_of, window):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, ids in ids_of.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], dtype="<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part))
            at += r["length"]
        assert at == len(ids)
    for part in by_sequence.values():
        at = 0
        for r in sorted(part, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    return sum(map(len, ids_of.values())) / (window * len(by_sequence))


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def test_packing_round_trip(spark, docs, encode):
    ids = {d: encode(r["text"]) for d, r in docs.items()}
    assert check_packing(queries.op9_packing(spark, SF).collect(), ids, 4096) > 0.95
    fill = check_packing(packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), queries.tokenizer_path(), window=700).collect(), ids, 700)
    assert fill > 0.97


def test_packing_cuts_what_does_not_fit(spark, encode):
    text = " ".join(["word"] * 2099)
    frame = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string")
    rows = packing.pack(frame, queries.tokenizer_path()).collect()
    assert check_packing(rows, {i: encode(text) for i in range(40)}, 4096) > 0.97
    assert packing.pack(odd_rows(spark).limit(0), queries.tokenizer_path()).count() == 0
    assert packing.pack(odd_rows(spark), queries.tokenizer_path()).where("doc_id = 1 and length = 1").count() == 1


@pytest.mark.parametrize(
    "text", ["Don't stop, it's 42!", "a\x1cb c d", "<|endoftext|> x<|startoftext|>y", "É́è ÀÇ, naïve... \"q\"", "x\t\ty\r\nz", "ß ÿ Þórr! 你好 😀", "İstanbul ﬁ"]
)
def test_words_have_the_ids_of_the_text(encode, text):
    assert packing.token_ids(text, queries.tokenizer_path()).tolist() == encode(text)


def test_private_data_is_replaced_alike(spark, docs):
    rows = {r["doc_id"]: r for r in queries.op10_surrogates(spark, SF).collect()}
    new = {}
    for d, r in docs.items():
        entities = surrogates.find_entities(r["text"])
        assert rows[d]["n_entities"] == len(entities)
        at, old_at = 0, 0
        for e, s in zip(entities, rows[d]["entities"], strict=True):
            assert rows[d]["text"][at : s["first"]] == r["text"][old_at : e.first]
            put = rows[d]["text"][s["first"] : s["last"]]
            assert new.setdefault((e.kind, e.value), put) == put and put != r["text"][e.first : e.last]
            at, old_at = s["last"], e.last
        assert rows[d]["text"][at:] == r["text"][old_at:]
    assert len(set(new.values())) == len(new)


def test_surrogates_keep_type_and_coreference():
    text = "Mr. John Smith and Frau Müller: +1 (521) 555-6210, 4539 1488 0343 6467, DE89 3704 0044 0532 0130 00. Smith left. 9870157079875996"
    entities = surrogates.find_entities(text)
    table = {(e.kind, e.value): surrogates.surrogate(e.kind, e.value, 0, b"k") for e in entities}
    done, spans = surrogates.replace_entities(text, table)
    kinds = [e.kind for e in entities]
    assert kinds == ["given_m", "surname", "surname", "phone", "card", "iban", "surname"]
    put = [done[a:b] for _, a, b in spans]
    assert put[1] == put[6] and put[0] in surrogates.GIVEN["latin", "m"] and "9870157079875996" in done
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", put[3]) and surrogates.luhn(put[4].replace(" ", ""))
    assert surrogates._iban_holds(put[5].replace(" ", ""))


def test_surrogates_are_distinct(spark):
    names = [("surname", f"{a}{b}{c}".capitalize()) for a in "klmnprst" for b in ("an", "er", "il") for c in "abdefghiklmnoprstuvw"]
    frame = spark.createDataFrame([*names, *[("given_f", n) for n in surrogates.GIVEN["latin", "f"]]], "kind string, value string")
    found = surrogates.assign_surrogates(frame, b"key").collect()
    assert len(found) == len(names) + 16 == len({(r["kind"], r["new"]) for r in found})
    assert not {(r["kind"], r["new"]) for r in found} & {(r["kind"], r["value"]) for r in found}


def test_private_data_in_odd_rows(spark):
    rows = surrogates.pseudonymize(odd_rows(spark), b"key").collect()
    assert len(rows) == 8 and sum(r["n_entities"] for r in rows) == 1 and [r["text"] for r in rows if r["doc_id"] == 1] == [None]
    assert surrogates.pseudonymize(odd_rows(spark).limit(0), b"key").count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = frame.columns, []
    for number, (name, work) in enumerate(corpus_pipeline.STAGES):
        work(spark, frame, SF).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        if number < 4:
            assert frame.columns == columns
            ids.append({r["doc_id"] for r in frame.select("doc_id").collect()})
    kept = {r["doc_id"] for r in queries.op4_quality_rules(spark, SF).where("kept").collect()}
    alone = brute_kept({doc_id: docs[doc_id]["text"] for doc_id in kept})
    assert ids[0] == kept and ids[1] == alone == ids[2] and ids[3] <= ids[2]
    assert {r["doc_id"] for r in frame.select("doc_id").collect()} == ids[3]
