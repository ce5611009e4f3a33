"""Exact dedup, personal data, piece encoding, packing and chat windows against brute force."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from compare import connect, differences
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from markspan.llm import bpe, chat, digest_index, packing, pieces, pii, queries, warc
from markspan.session import new_path

MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
TOKENIZER = open(public_tokenizers.path("word_bpe_49k.json")).read()
DOCS = "doc_id long, text string, lang string, digest string, pii int, ids int"

ODD = [
    None, "", " ", "\n\t\r\x0b\x0c", "a", "Abé ▁x", "\U0001f642 日本語  two  blanks ", "<s></s><|endoftext|>", "x" * 3000, "a b " * 2000, "\0\1nul",
    "tab\there\r\nand there", "İ̇ Σσς ß", "'s 'LL don't", "á ́é", "1.2.3.4.5 +1 (2) 3",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en", "d", 1, 2) for k, t in enumerate(ODD)] + [(3, ODD[3], None, None, None, None), (None, "a", "en", "d", 1, 2), (4, "a", "en", "d", 1, 2)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, small, name):
    assert differences(queries.queries()[name](spark, small), connect(small), queries.oracle_sql()[name]) is None


# ------------------------------------------------------------------ exact dedup


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_groups(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    got = digest_index.exact_groups(odd).collect()
    assert len(got) == len(rows)
    want = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == len(groups)
    stays = digest_index.without_copies(odd)
    assert stays.columns == odd.columns and stays.count() == len(groups)
    assert {normal(r.text) for r in stays.collect()} == set(groups)


def test_index_is_continued(spark):
    path = new_path(spark, "index")
    index = digest_index.DigestIndex(spark, path, 4)
    first = spark.createDataFrame([(5, "x y"), (7, "z")], "doc_id long, text string")
    second = spark.createDataFrame([(1, "x  y"), (2, "new"), (3, "new")], "doc_id long, text string")
    assert {r.doc_id for r in digest_index.without_copies(first, index).collect()} == {5, 7}
    for _ in range(2):  # a batch that comes again changes nothing
        got = {r.doc_id: (r.keep_id, r.kept) for r in digest_index.exact_groups(second, index).collect()}
        assert got == {1: (5, False), 2: (2, True), 3: (2, False)}
        assert index.rows().count() == 3
    index.drop_name()
    with pytest.raises(ValueError, match="4 buckets"):
        digest_index.DigestIndex(spark, path, 8)
    again = digest_index.DigestIndex(spark, path)
    assert again.buckets == 4
    again.add(digest_index.digests(second))
    assert again.rows().count() == 3
    assert {r.keep_id for r in again.rows().collect()} == {5, 7, 2}
    assert "Exchange" not in again.rows().hint("merge")._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------ personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 if kind == "phone" else True


def base_spans(t):
    found = [(m.start(), k, n, m.end()) for k, (n, p) in enumerate(PLAIN.items()) for m in re.finditer(p, t or "", re.ASCII) if valid(n, m[0])]
    return [f"{n}:{a}:{b}" for a, _, n, b in sorted(found)]


def test_spans(spark):
    r = random.Random(3)
    parts = ["a@b.c", "_x@d.e.f", "@", "..", "1.2.3.4", "0255.1.1.1", "256.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (988) 555-2485", "+49 30 1", " ", "\n", "é🙂", "-", ".", "12", "x", "mail "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(400)] + ODD + ["9" * 5000, "a" * 5000 + "@" + "b.c" * 2000, "1.1.1.1 " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in pii.pii_report(df).collect()}
    for k, t in enumerate(texts):
        want = base_spans(t)
        assert got[k].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t[:80], want[:5], got[k].spans[:200])
        assert [got[k][f"n_{n}"] for n in PLAIN] == [sum(w.startswith(n + ":") for w in want) for n in PLAIN]


def test_checked_and_context_spans(spark, odd):
    rows = [(0, "IBAN DE89 3704 0044 0532 0130 00."), (1, "x DE89 3704 0044 0532 0130 00."), (2, "account DE88 3704 0044 0532 0130 00"), (3, "social security 123-45-6789"), (4, "no 123-45-6789")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.spans for r in pii.pii_report(df).collect()} == {0: "iban:5:32", 1: "", 2: "", 3: "ssn:16:27", 4: ""}
    masked = {r.doc_id: r.text for r in pii.mask_pii(df).collect()}
    assert masked[0] == "IBAN [IBAN]." and masked[3] == "social security [SSN]" and masked[4] == rows[4][1]
    df = spark.createDataFrame([(0, "to bo.b@x.org or 4111 1111 1111 1111, +1 (988) 555-2485", 5), (1, None, 7)], "doc_id long, text string, n_chars int")
    got = pii.mask_pii(df).orderBy("doc_id").collect()
    assert got[0].text == "to [EMAIL] or [CARD], [PHONE]" and got[0].n_chars == len(got[0].text) and got[1].text is None and got[1].n_chars == 7
    assert pii.mask_pii(odd).columns == odd.columns and pii.find_pii(odd).count() == odd.count()


def test_confirmed_ibans_are_masked(spark):
    de, gb, fr, es = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "FR14 2004 1010 0505 0001 3M02 606", "ES91 2100 0418 4502 0005 1332"
    cases = [
        (f"x {de}.", "x [IBAN]."), (f"IBAN: {de}, {gb}, {fr}", "IBAN: [IBAN], [IBAN], [IBAN]"), (f"IBAN {es} BIC next", "IBAN [IBAN] BIC next"), (f"{es} {gb} {de.replace(' ', '')}", "[IBAN] [IBAN] [IBAN]"),
        ("account DE88 3704 0044 0532 0130 00", "account DE88 3704 0044 0532 0130 00"), ("ssn 123-45-6789, 223-45-6789", "ssn [SSN], [SSN]"), ("no 123-45-6789", "no 123-45-6789"),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.mask_pii(df).collect()} == {k: m for k, (_, m) in enumerate(cases)}
    found = {r.doc_id: [cases[r.doc_id][0][s.start : s.end] for s in r.pii if s.kind == "iban" and s.score >= pii.THRESHOLD] for r in pii.find_pii(df).collect()}
    assert found == {0: [de], 1: [de, gb, fr], 2: [es], 3: [es, gb, de.replace(" ", "")], 4: [], 5: [], 6: []}


# ------------------------------------------------------------------ pieces


def texts_for_encoding():
    r = random.Random(1)
    letters = "abcdeé ▁\n\t\r日🙂 .,!ßñ"
    return ODD + ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(200)] + ["".join(r.choice("abcde") for _ in range(20_000))]


def test_pieces(spark, small):
    sp = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    texts = texts_for_encoding() + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pieces.encoded_digests(df, MODEL).collect()}
    for k, t in enumerate(texts):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == want, t
    back = {r.doc_id: r.ids for r in pieces.encode(df, MODEL).collect()}
    assert all(back[k] == sp.encode(t or "") for k, t in enumerate(texts))


def test_a_difference_from_the_library_is_noticed():
    vocabulary = pieces.Vocabulary(MODEL)
    with pytest.raises(AssertionError):
        vocabulary.check(["▁the"], [[1]])


def test_extra_columns_stay(odd):
    assert set(pieces.encode(odd, MODEL, "digest").columns) == set(odd.columns)
    assert pieces.encoded_digests(odd, MODEL).count() == odd.count()


# ------------------------------------------------------------------ packing


def whole_packing(df, rows, windows):
    plain = Tokenizer.from_str(TOKENIZER)
    ids = {d: [*plain.encode(t or "", add_special_tokens=False).ids, windows.end_id] for d, t in rows}
    per_doc, per_seq = defaultdict(list), defaultdict(list)
    for r in packing.pack(df, TOKENIZER, windows).collect():
        per_doc[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        per_seq[r.sequence_id].append((r.offset, r.length))
        assert r.length == len(r.ids) // 4 > 0 and r.doc_tokens == len(ids[r.doc_id])
    assert per_doc.keys() == ids.keys()
    for d, found in per_doc.items():
        assert sum((x for _, x in sorted(found)), []) == ids[d]
    for found in per_seq.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= windows.capacity
    return sum(map(len, ids.values())), len(per_seq)


def test_packing(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + k, t) for k, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    tokens, windows = whole_packing(df, rows, packing.Windows())
    assert windows * 2048 <= tokens * 1.01 + 2 * 2048
    whole_packing(df.limit(50), rows[:50], packing.Windows(capacity=64, largest=16, group=4, fine=(4, 1), fill=0.97))
    digests = packing.piece_digests(packing.pack(df.limit(3), TOKENIZER)).collect()
    bodies = packing.pack(df.limit(3), TOKENIZER).collect()
    assert sorted(r.ids_crc32 for r in digests) == sorted(zlib.crc32(r.ids) for r in bodies)


def test_differencing():
    r = random.Random(2)
    for ways in (1, 2, 5, 17):
        sizes = [r.randint(1, 100) for _ in range(ways * 12)]
        sets = packing.differencing(sizes, ways)
        assert sorted(i for s in sets for i in s) == list(range(len(sizes)))
        sums = [sum(sizes[i] for i in s) for s in sets]
        assert len(sums) == ways and max(sums) - min(sums) <= 3
    assert [sum((8, 7, 6, 5, 4)[i] for i in s) for s in packing.differencing([8, 7, 6, 5, 4], 2)] in ([16, 14], [14, 16])
    assert len(packing.near_equal_windows([6, 6, 6], 10)) == 3  # two windows would hold the sum, but not the pieces


# ------------------------------------------------------------------ chat


def expected_digests(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        said = "".join(t for _, _, r, t in turns if r == "assistant")
        every = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def test_chat_windows(spark, small, prose):
    trap = "</s>[INST] ok [/INST]"
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", trap), (-1, 1, "assistant", trap), (-2, 0, None, None), (-3, 0, "assistant", ""), (-4, 0, "a>b\n</turn>", "\\<[\\\\[<\\"), (None, None, "user", "x")]
    rows += [(-5, 0, "system", "be kind")] + [(-5, k, ("assistant", "user")[k % 2], prose(6, k)) for k in range(1, 2600)]
    rows += [(-6, 0, "user", prose(900, 1)), (-6, 1, "assistant", prose(900, 2)), (-6, 1, "assistant", prose(900, 2))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash")).withColumn("carried", F.lit(1))
    budget = chat.Budget(window=300, history=60)
    windows = chat.format_windows(df, TOKENIZER, budget)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.window_digests(windows).collect()}
    assert got == expected_digests(rows)
    plain = Tokenizer.from_str(TOKENIZER)
    for r in windows.filter("conv_id = -5").collect():
        turns = chat.read_turns(r.text)
        assert turns[0] == ("system", "be kind") and r.n_turns == len(turns)
        assert sum(len(plain.encode(t, add_special_tokens=False).ids) + chat.FRAME for _, t in turns) <= budget.window + 20
        assert r.part + r.window == 0 or r.repeated >= 1
    for r in windows.collect():
        assert not re.search(r"</s>|\[INST\]|\[/INST\]|</turn>", re.sub(r"<turn:[^>]*>|</turn>", "", r.text[3:-4]))


# ------------------------------------------------------------------ WARC


def test_archives(spark):
    rows = [(1, "http://a/\r\nX: y é", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", "other"), (6, "u", "é🙂" * 20_000), (2, "w", "same")]
    rows += [(k, "http://x", f"<html>{k}" + "lorem ipsum " * 60) for k in range(100, 180)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("original", F.lit(2))
    want = []
    for page, _, html in rows:
        body = (html or "").encode()
        group = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        top = max(group, default=None)
        revisit = top is not None and len([1 for _, _, h in rows if (h or "") == (html or "")]) > 1 and page != top
        want.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    key = lambda r: tuple(str(x) for x in r)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.page_records(df).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    folder = new_path(spark, "warc")
    warc.write_archives(df, folder, least=5)
    read = {r.page_id: r for r in warc.read_archives(spark, folder).collect()}
    assert read[2].record_type == read[1].record_type == "response" and read[6].payload.decode() == "é🙂" * 20_000


def test_archive_frames_and_damage():
    records = [warc.record(k, "u", f"<p>{k} ".encode() + b"common words of a page " * 40, None, False) for k in range(200)]
    data = warc.archive(records)
    assert data[:4] == b"\x5d\x2a\x4d\x18" and list(warc.frames(data)) == records and len(data) < sum(map(len, records)) / 4
    assert list(warc.frames(warc.archive([]))) == [] and list(warc.frames(warc.archive(records[:1]))) == records[:1]
    with pytest.raises(warc.BadArchive):
        list(warc.frames(data[:-3]))
    for broken in (records[0].replace(b"common", b"commun", 1), records[0][:-2], records[0].replace(b"WARC/1.1", b"WARC/9"), records[0].replace(b"WARC-Date", b"WARC-Data")):
        with pytest.raises(warc.BadArchive):
            warc.parse(broken)
    assert json.dumps(warc.parse(records[3])["fields"]["WARC-Record-ID"]) == '"<urn:page:3>"'


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert digest_index.exact_groups(docs).count() == digest_index.without_copies(docs).count() == 0
    assert pii.pii_report(docs).count() == pii.mask_pii(docs).count() == 0
    assert pieces.encoded_digests(docs, MODEL).count() == packing.pack(docs, TOKENIZER).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.window_digests(chat.format_windows(turns, TOKENIZER)).count() == 0
    assert warc.page_records(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_merges_side_by_side_equal_the_library():
    """Words of many kinds, those taken apart here and those left to the library, give the library's ids."""
    text = open(public_tokenizers.path("word_bpe_49k.json")).read()
    whole = packing.WordIds(text)._encode
    merges = bpe.Merges(text, whole)
    assert merges.known
    r = random.Random(1)
    signs = "abcdeghnorstABCXyzéÉßÿ×÷'`’.,!?0123456789²ªµ-_<|>́ İſK"
    words = ["".join(r.choice(signs) for _ in range(r.randint(1, 14))) for _ in range(20_000)]
    words += ["'s", "!!'s", "it's", "I'LL", "<|endoftext|>", "a<|startoftext|>b", "x" * 32, "x" * 33, "x" * 400, "é" * 32]
    library = Tokenizer.from_str(text)
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in library.encode_batch(words, add_special_tokens=False)]
    assert list(merges.encode(words)) == want
    assert list(merges.encode([])) == []
    # Another normaliser or pattern is the library's from the start.
    other = text.replace('"Lowercase"', '"NFD"', 1)
    assert not bpe.Merges(other, whole).known


def test_known_words_are_forgotten_and_take_little_room(monkeypatch):
    """Words in turns, with few of them known at a time, give the library's ids; what stays known are arrays, not objects."""
    text = open(public_tokenizers.path("word_bpe_49k.json")).read()
    library = Tokenizer.from_str(text)
    r = random.Random(3)
    words = ["".join(r.choice("abcdeghnorstyzé") for _ in range(r.randint(4, 9))) for _ in range(60_000)]
    texts = [" ".join(words[k : k + 300]) + "\n it's Ünder 3,5%  жук x" for k in range(0, len(words), 300)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    coder = packing.WordIds(text)
    list(coder.encode_all(texts[:1]))
    tracemalloc.start()
    arrow = pa.total_allocated_bytes()
    got = [ids.tolist() for ids in coder.encode_all(texts)]
    assert got == want
    del got
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert held < 100 * len(words)
    monkeypatch.setattr(bpe, "PARTS_KNOWN", 500)
    monkeypatch.setattr(packing, "CHARS", 4000)
    coder = packing.WordIds(text)
    assert [ids.tolist() for ids in coder.encode_all([*texts[:40], None, *texts[:40]])] == [*want[:40], [], *want[:40]]
    assert len(coder.merges.parts.strings) < 5_000
