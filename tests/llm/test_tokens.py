"""Token counts, packing and language identification against the libraries themselves."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from placeworks.llm import language_id, packing, token_counts
from placeworks.llm.store import table


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def counts(texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return [len(x) for x in model.encode(texts)]


def test_counts_of_odd_texts(frame, odd):
    rows = odd + [(k, t) for k, t in enumerate([" ", "  ", " a", "a ", "a\n", "\n\na  b", "▁", "▁▁x ▁", "é　\xa0x", "\t\r\n"], 10)]
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(frame(rows)).collect())
    expected = sorted((i or -1, len((t or "").encode()), n, n > 4096) for (i, t), n in zip(rows, counts([t or "" for _, t in rows])))
    assert got == expected


@pytest.mark.parametrize("bits", [4, 16])
def test_counts_when_hashes_are_shared(spark, sf_dir, frame, odd, bits):
    """With a short hash most pre-tokens share theirs with others; the counts are the same."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").union(frame(odd).select("doc_id", "text"))
    rows = docs.collect()
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in token_counts.count_tokens(docs, hash_bits=bits).collect())
    assert got == sorted((r["doc_id"] or -1, n) for r, n in zip(rows, counts([r["text"] or "" for r in rows])))


def test_counts_of_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs).collect()}
    assert got == dict(zip(texts, counts(list(texts.values()))))
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_pretokens_are_combined_before_they_are_rows(spark, sf_dir, frame, odd):
    """A pre-token comes once a slice of text, not once an occurrence, and the sums are those of a plain search."""
    texts = [t or "" for _, t in odd] + [r["text"] for r in table(spark, sf_dir, "documents").collect()]
    expected = Counter(u for t in texts if t for u in re.findall(r"(?:\n| +)[^ \n]*", " " + t.replace("▁", " ")))
    rows = token_counts.distinct_units(frame(list(enumerate(texts))).select("text").repartition(1)).collect()
    got = Counter()
    for r in rows:
        got[r["unit"]] += r["freq"]
    assert got == expected
    slices = sum(map(len, (t.encode() for t in texts))) // token_counts.tk.SLICE_BYTES + 2
    assert max(Counter(r["unit"] for r in rows).values()) <= slices and len(rows) < sum(expected.values()) / 2


def check_pieces(rows, texts, tokenizer, size, may_be_short):
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]
    by_sequence, total = {}, 0
    crcs = {}
    for x in ids:
        for r in rows:
            if r["doc_tokens"] == len(x) and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]:
                crcs[id(r)] = True
    for r in rows:
        assert id(r) in crcs, r
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        total += r["length"]
    assert total == sum(map(len, ids))
    short = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= size
        short += at < size
    assert short <= may_be_short


@pytest.mark.parametrize("parts", [1, 3])
def test_packing_odd_texts(frame, odd, tokenizer, parts):
    rows = packing.pack(frame(odd).repartition(parts), open_windows=2, size=64).collect()
    check_pieces(rows, [t for _, t in odd], tokenizer, 64, 1)
    assert packing.pack(frame(odd).limit(0)).count() == 0


def test_packing_documents(spark, sf_dir, tokenizer):
    docs = table(spark, sf_dir, "documents").repartition(4)
    rows = packing.pack(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    ids = {k: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4") for k, t in texts.items()}
    spans = {}
    for r in rows:
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        spans.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for k, pieces in spans.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == len(ids[k])
    full = {}
    for r in rows:
        full[r["sequence_id"]] = full.get(r["sequence_id"], 0) + r["length"]
    assert max(full.values()) <= 1024 and sum(1024 - x for x in full.values()) <= 1023


def test_same_ids_as_the_library_on_the_larger_table(spark, tokenizer):
    texts = [r["text"] for r in table(spark, "/root/testdata/sf0.01", "documents").collect()] + ["ab" * 3000, " " * 3000, "\n" * 50 + "x", "é" * 999, "1234567890" * 200, "!?" * 500]
    fast = packing.byte_bpe()
    assert [fast.encode(t, allowed_special="all") for t in texts] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_same_ids_as_the_library(tokenizer):
    fast = packing.byte_bpe()
    texts = ["it's  a\n\n test", " <|endoftext|>x", "naïve Ærø 123.45", "　  \t", "漢字かな交じり文", "a" * 500]
    assert [fast.encode(t, allowed_special="all") for t in texts] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_language_of_odd_texts(spark, sf_dir, frame, odd):
    learned = language_id.learn(table(spark, sf_dir, "documents"))
    got = language_id.identify(frame(odd), learned).collect()
    assert len(got) == len(odd)
    by = {(r["doc_id"], r["lang_pred"]) for r in got}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "en"), (7, "de")} <= by
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in language_id.identify(frame(odd), {}).collect()} == {"und"}
    assert language_id.learn(table(spark, sf_dir, "documents").limit(0)) == {}


def test_language_by_plain_compression(spark, sf_dir):
    """Every row of the whole table against compressors made one text and one block at a time."""
    import zstandard as z

    from placeworks.llm.queries import op1_language_id
    from placeworks.llm.store import fold

    docs = table(spark, sf_dir, "documents")
    learned = language_id.learn(docs.filter(fold("doc_id", 3) != 1))
    assert all(len(d) <= language_id.DICTIONARY_BYTES for d in learned.values())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = op1_language_id(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)

    def size(lang, data):
        coder = z.ZstdCompressor(level=language_id.LEVEL, dict_data=z.ZstdCompressionDict(learned[lang], dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(coder.compress(data))

    for r in rows[::7]:
        text = " " + " ".join("".join(c if c.isalpha() else " " for c in texts[r["doc_id"]].lower()).split()) + " "
        data, total = text.encode(), {}
        for lang, content in learned.items():
            ahead = content[-language_id.CONTEXT_BYTES :]
            total[lang] = sum(size(lang, ahead + data[k : k + language_id.BLOCK_BYTES]) - size(lang, ahead) for k in range(0, len(data), language_id.BLOCK_BYTES))
        assert total[r["lang_pred"]] <= min(total.values()) + 2


def test_pieces_come_from_whole_texts(spark, frame):
    """Long texts teach too, from anywhere in them."""
    rows = [(k, "alpha " * 30_000 + "omega " * 30_000) for k in range(40)]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in rows], "doc_id long, text string, lang string").selectExpr("doc_id", "concat(doc_id, text) as text", "lang", "'a' as piece", "1 as at", "2 as nth")
    learned = language_id.learn(docs)["xx"]
    assert b"alpha" in learned and b"omega" in learned and len(learned) <= language_id.DICTIONARY_BYTES


def test_language_held_out(spark, sf_dir):
    from placeworks.llm.queries import op1_language_id

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = op1_language_id(spark, sf_dir).join(docs, "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows) > 0
