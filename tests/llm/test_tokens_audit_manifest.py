"""ORC token files, the filter audit and the Merkle manifest against spelt-out versions."""

import array
import glob
import hashlib
import random
import re
import zlib
from itertools import permutations

import pyarrow.orc
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from ledgerloom.llm import filter_audit, merkle_manifest, orc_tokens

DOC = "doc_id long, text string, source string, lang string, n_chars long"


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- op11 --------------------------------------------------------------------------------------------------------------

TEXTS = ["", None, "One two's café́", "  lead and trail \n", "漢字 😀 don't <|endoftext|> A1b2", "x" * 5000, "w, " * 30_000, "a b c\x1cd\x85e", "İSTANBUL ΣΑΣ ß", "straße größen ÿßæ déjà vu, Müller's über-all; naïve. 3.5, x9! o'k ?? a?!b e\u0301t"]


def plain_ids(text):
    t = Tokenizer.from_file(public_tokenizers.path(orc_tokens.VOCABULARY))
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_tokens_are_those_of_the_library_in_order(spark, tmp_path):
    r = random.Random(1)
    rows = [(i * 7 % 101, r.choice(TEXTS)) for i in range(60)] + [(None, "no id"), (5, "again"), (5, "again"), (5, "and again")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, ids string, start int").repartition(5)
    folder = f"file://{tmp_path}/tokens"
    orc_tokens.write_tokens(docs, folder)
    got = orc_tokens.read_tokens(spark, folder).collect()
    got.sort(key=lambda x: x.start)
    assert [x.doc_id for x in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    total, want = 0, {}
    for i, t in rows:
        want.setdefault(i, []).append(plain_ids(t))
    for x in got:
        assert x.start == total and x.n_tokens == len(x.ids)
        want[x.doc_id].remove(x.ids)
        total += x.n_tokens
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in orc_tokens.with_checksum(orc_tokens.read_tokens(spark, folder)).collect()}
    assert all(sums[x.doc_id, x.start] == zlib.crc32(array.array("I", x.ids).tobytes()) for x in got)


def test_files_are_read_stripe_by_stripe_and_pruned_by_metadata(spark, tmp_path):
    r = random.Random(2)
    docs = spark.range(0, 40_000, 2).selectExpr("id AS doc_id", "repeat(concat(uuid(), ' '), 16) AS text").coalesce(1)
    folder = f"file://{tmp_path}/tokens"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        orc_tokens.write_tokens(docs, folder, stripe_bytes=1 << 20, row_index=1000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    (file,) = glob.glob(f"{tmp_path}/tokens/part-*")
    assert pyarrow.orc.ORCFile(file).nstripes > 2
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        read = orc_tokens.read_tokens(spark, folder)
        assert read.rdd.getNumPartitions() > 2 and read.count() == 20_000 and read.selectExpr("max(start + n_tokens)", "sum(n_tokens)").distinct().first()[0] == read.selectExpr("sum(n_tokens)").first()[0]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    wanted = sorted(r.sample(range(0, 40_000, 2), 2))
    read_rows = []
    for ids in (wanted, [wanted[0] + 1, 39_999]):  # odd ids lie within the statistics, so only the Bloom filters exclude them
        found = orc_tokens.lookup(spark, folder, ids)
        assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()
        assert [x.doc_id for x in found.orderBy("doc_id").collect()] == [i for i in ids if i % 2 == 0]
        plan = found._jdf.queryExecution()
        plan.executedPlan().executeCollect()
        scan = plan.executedPlan().collectLeaves().head()
        read_rows.append(scan.metrics().apply("numOutputRows").value())
    assert read_rows[0] <= 2 * 2000 and read_rows[1] <= 2000


def test_words_are_encoded_once_whatever_their_case_and_closing_marks():
    words, marks = ["word", "élan", "straße", "3rd", "don't", "ñ"], [".", ",###", "%%%", "*_~", "$"]
    own = orc_tokens.Encoder(public_tokenizers.path(orc_tokens.VOCABULARY))

    def check(texts):
        ids, begins = own.encode(pyarrow.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == [plain_ids(t) for t in texts]

    check([" ".join(f"{form}{m}" for w in words for form in (w, w.capitalize()) for m in ("", *marks)), ""])
    assert set(own.at) == {*words, *marks, ""}
    check(["Élan''. l'Éa\u0301!! A\u0301? Œuf## ﬁ. x<\u0338 \u0338. İ, ΑΣ. ²$ ª% × ÷, \u212bb.", "'S. 'Ll, É's! (Élan) <|endoftext|>."])


def test_tokens_of_an_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    orc_tokens.write_tokens(spark.createDataFrame([], DOC), folder)
    assert orc_tokens.with_checksum(orc_tokens.read_tokens(spark, folder)).collect() == []


# --- op12 --------------------------------------------------------------------------------------------------------------


def fails(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
    }


def brute_audit(rows, labels):
    texts = {}
    for i, t, _ in rows:
        if i is not None:
            texts[t or ""] = min(texts.get(t or "", i), i)
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    judged = [(s or "", i, {**fails(t or ""), "E": i is not None and i > texts[t or ""]}) for i, t, s in rows]
    out = {}
    for part in {s for s, _, _ in judged}:
        own = [(i, {f for f, v in x.items() if v}) for s, i, x in judged if s == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone),
                ]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return sorted(((*k, *v) for k, v in out.items()), key=repr)


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_rows(seed, n):
    r = random.Random(seed)
    texts = [None, "", " \t\n", "\x0bA b\x0c#", "word " * 60, " ".join(f"w{i}" for i in range(49)), " ".join(f"w{i}" for i in range(50)), " ".join(f"W{i} |" for i in range(80)), "ÄB c " * 20, "x\x1cy\x85z " * 50]
    texts += [" ".join(r.choice("abc") + str(r.randint(0, 60)) for _ in range(r.randint(40, 90))) for _ in range(10)]
    rows = [(r.choice([None, *range(n)]), r.choice(texts), r.choice([None, "", "s1", "s2", "s3"])) for _ in range(n)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, n, 2)] + [(0, 1, 1), (None, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("ascending", [False, True])
def test_audit_equals_brute_force_however_files_arrive(spark, tmp_path, ascending):
    rows, labels = audit_rows(3, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    stored = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    # one file after the other; descending ids make every file retract what the one before counted
    ordered = sorted(rows, key=lambda x: -1 if x[0] is None else x[0], reverse=not ascending)
    for k in range(4):
        spark.createDataFrame(ordered[k * 75 : k * 75 + 75], docs.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    found = filter_audit.interactions(filter_audit.audit(spark, f"{tmp_path}/documents.parquet", stored))
    assert rows_of(found, *AUDIT) == brute_audit(rows, labels)


def test_audit_goes_on_with_new_files_only(spark, tmp_path):
    rows, labels = audit_rows(4, 200)
    stored = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    path, folder = f"{tmp_path}/documents.parquet", f"file://{tmp_path}/state"
    for k, part in enumerate((rows[:120], rows[120:])):
        spark.createDataFrame(part, "doc_id long, text string, source string").coalesce(1).write.mode("append").parquet(path)
        counters = filter_audit.audit(spark, path, stored, folder)
        seen = rows[: 120 + 80 * k]
        assert rows_of(filter_audit.interactions(counters), *AUDIT) == brute_audit(seen, labels)
    assert len(glob.glob(f"{tmp_path}/state/changes/batch=*")) == 2
    again = filter_audit.audit(spark, path, stored, folder)
    assert rows_of(filter_audit.interactions(again), *AUDIT) == brute_audit(rows, labels) and len(glob.glob(f"{tmp_path}/state/changes/batch=*")) == 2


def test_audit_retracts_holders():
    held = filter_audit.Held()
    held.add("t", "p", 1, 9, (2, 0, 0), (1, 0, 0))
    assert held.changes == {("p", 1): [1, 0, 0], ("p", 1 | filter_audit.COPY): [1, 0, 0]} and held.texts["t"][0] == 9
    held.changes = {}
    held.add("t", "q", 1, 4, (1, 1, 0), (1, 1, 0))
    assert {k: v for k, v in held.changes.items() if any(v)} == {("p", 1): [-1, 0, 0], ("p", 1 | filter_audit.COPY): [1, 0, 0], ("q", 1): [1, 1, 0]}


def test_audit_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.interactions(filter_audit.audit(spark, f"{tmp_path}/documents.parquet", labels)).collect() == []


# --- op13 --------------------------------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[2], row[3], row[4], row[1])))


def climb(nodes, k):
    """Per node (left, right) of every level on the way up, and what remains."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + k] for i in range(0, len(nodes), k)]
        for n, p in enumerate(place):
            run = runs[p // k]
            paths[n].append(("".join(run[: p % k]), "".join(run[p % k + 1 :])))
            place[n] = p // k
        nodes = [h(*run) for run in runs]
    return paths, nodes[0] if nodes else None


def brute_proofs(rows, k):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, leaf(x)))
        trees[s] = own, *climb([leaf(x) for x in own], k)
    upper, root = climb([trees[s][2] for s in names], k)
    out = []
    for s, above in zip(names, upper, strict=True):
        own, paths, subroot = trees[s]
        for row, path in zip(own, paths, strict=True):
            path = path + above
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            text = row[1] if row[1] is None or not hit else re.sub("[A-Z]", lambda m: m.group().lower(), row[1])
            folded = leaf((row[0], text, *row[2:]))
            for left, right in path:
                folded = h(left, folded, right)
            out.append((row[0], leaf(row), subroot, root, h(*(x for side in path for x in side)), folded, folded == root))
    return sorted(out, key=repr)


PROOF = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("fanout, n", [(2, 40), (3, 60), (16, 700), (16, 1), (4, 0)])
def test_proofs_equal_brute_force(spark, fanout, n):
    r = random.Random(n)
    texts = [None, "", "Abc Ä", "plain", "X" * 3000, "1:-"]
    rows = [(r.choice([None, r.randint(0, n)]), r.choice(texts), r.choice(["hot"] * 20 + [None, "", "-", "é", "z", "~", "Z"]), r.choice([None, "en"]), r.choice([None, 3])) for _ in range(n)]
    docs = spark.createDataFrame([(*x, "clash", 0) for x in rows], DOC + ", tree string, place int").repartition(4)
    found = merkle_manifest.proofs(merkle_manifest.document_leaves(docs), fanout)
    assert rows_of(found, *PROOF) == brute_proofs(rows, fanout)


def test_a_changed_row_fails_and_the_others_stay(spark):
    rows = [(i, f"Text {i}", f"s{i % 3}", "en", 6) for i in range(100)]
    out = merkle_manifest.proofs(merkle_manifest.document_leaves(spark.createDataFrame(rows, DOC))).collect()
    hit = {i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {x.doc_id for x in out if not x.verified} == hit and len({x.root for x in out}) == 1 and len({x.subroot for x in out}) == 3
