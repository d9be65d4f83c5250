import bisect
import random
from collections import Counter

import public_tokenizers
import pytest
from awkward_rows import awkward, empty  # noqa: F401
from raterscope.llm import packing, sharding, token_counts
from tokenizers import Tokenizer

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def texts():
    random.seed(1)
    alphabet = "abstremvldLE'''   \n\t\r é1２٣ñß中文字😀!?.,-_=*<|>  \x1c\x00̈　"
    made = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 60))) for _ in range(3000)]
    points = [(32, 126), (0xA0, 0x2FFF), (0x3000, 0xD7FF), (0xE000, 0x10FFFF)]
    made += ["".join(chr(random.randint(*random.choice(points))) for _ in range(30)) for _ in range(500)]
    return made + ["", " ", "don't I'll we've 'r x'l", "a<|endoftext|>b <|endoftext|>  <|endoftext|><|startoftext|>", "=" * 300, "a" * 5000, " " * 777]


def test_counts_are_the_library_s():
    library = Tokenizer.from_file(str(BYTES))
    made = texts()
    expected = [len(e.ids) for e in library.encode_batch(made, add_special_tokens=False)]
    assert token_counts.transducer(str(BYTES)).counts([t.encode() for t in made]).tolist() == expected


def test_a_full_table_is_begun_anew():
    machine = token_counts.Transducer(str(BYTES))
    machine.merger.ROWS = 200
    made = texts()[:800]
    assert machine.counts([t.encode() for t in made]).tolist() == token_counts.transducer(str(BYTES)).counts([t.encode() for t in made]).tolist()


def test_token_count_rows(awkward, empty):
    got = token_counts.count_tokens(awkward, str(BYTES), limit=5)
    library = Tokenizer.from_file(str(BYTES))
    expected = Counter()
    for r in awkward.collect():
        text = r["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        expected[(r["doc_id"], len(text.encode()), n, n > 5)] += 1
    assert Counter(map(tuple, got.collect())) == expected
    assert token_counts.count_tokens(empty, str(BYTES)).count() == 0


def test_cached_ids_are_the_library_s():
    library, machine = Tokenizer.from_file(str(WORDS)), packing.CachedTokenizer(str(WORDS))
    machine.words.ENTRIES = machine.stretches.ENTRIES = 500
    import numpy as np

    made = texts()
    expected = [e.ids for e in library.encode_batch(made, add_special_tokens=False)]
    for at in range(0, len(made), 100):
        assert [np.frombuffer(b, "<u4").tolist() for b in machine.encode(made[at : at + 100])] == expected[at : at + 100]


def one_at_a_time(lengths, capacity):
    """Number of sequences of best-fit decreasing, one piece after the other."""
    gaps = []
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, length)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        bisect.insort(gaps, gap - length)
    return len(gaps)


def laid_out(matches):
    """Pieces of each length, and the tokens of every sequence, as the matches place them."""
    pieces, tokens = {}, {}
    for m in matches:
        for i in range(m.each * m.bins):
            assert (m.length, m.rank + i) not in pieces
            sequence, offset = m.sequence + i // m.each, m.offset + i % m.each * m.length
            pieces[m.length, m.rank + i] = sequence
            tokens.setdefault(sequence, []).append((offset, m.length))
    return pieces, tokens


@pytest.mark.parametrize("seed", range(5))
def test_a_sweep_is_that_of_one_piece_at_a_time(seed):
    random.seed(seed)
    lengths = [random.randint(1, random.choice([5, 20, 40])) for _ in range(400)]
    matches, without = packing.sweep([(n, 0, c) for n, c in Counter(lengths).items()], packing.Gaps(40), True)
    assert not without and len(laid_out(matches)[1]) == one_at_a_time(lengths, 40)
    assert sum(m.each * m.bins for m in matches) == len(lengths)


@pytest.mark.parametrize("seed", range(3))
def test_rounds_of_ranges_pack_as_well(spark, seed):
    """Every piece has a place, sequences have no holes, and they are as few as those of one piece at a time, but for one in a hundred."""
    random.seed(seed)
    capacity = (256, 2048, 64)[seed]
    lengths = [min(capacity, int(random.lognormvariate((4, 6, 2)[seed], 1)) + 1) for _ in range(3000)] + [1] * 500 + [capacity // 3] * 700
    counts = spark.createDataFrame(list(Counter(lengths).items()), "length long, n long")
    pieces, tokens = laid_out(packing.best_fit(counts, capacity))
    assert Counter(length for length, _ in pieces) == Counter(lengths)
    assert all((length, rank) in pieces for length, n in Counter(lengths).items() for rank in range(n))
    for own in tokens.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(tokens) <= 1.01 * one_at_a_time(lengths, capacity)


def test_packing_is_whole(spark, awkward, empty):
    docs = awkward.select("doc_id", "text").unionByName(
        spark.createDataFrame([(100 + i, f"word{i % 7} " * (i % 400)) for i in range(600)], "doc_id long, text string")
    )
    rows = packing.pack(docs, str(WORDS), capacity=256).collect()
    library = Tokenizer.from_file(str(WORDS))
    total = sum(len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(r["length"] for r in rows) == total
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by_sequence) <= 1.02 * total / 256 + 2
    assert packing.pack(empty, str(WORDS)).count() == 0


def test_shards_fit_and_only_full_ones_split(spark, awkward, empty):
    docs = awkward.select("doc_id", "text").unionByName(
        spark.createDataFrame([(100 + i, "x" * (i % 90)) for i in range(3000)] + [(50, "y" * 40)] * 1000, "doc_id long, text string")
    )
    rows = sharding.assign_shards(docs, 4000).collect()
    assert len(rows) == docs.count()
    held = Counter()
    for r in rows:
        held[r["shard"]] += r["n_bytes"]
    sizes = {r["shard"]: (r["shard_bytes"], r["shard_rows"], r["shard_depth"]) for r in rows}
    assert all(held[s] == sizes[s][0] and len(s) == sizes[s][2] for s in held)
    assert all(b <= 4000 or n == 1 for b, n, _ in sizes.values())
    # The parent of each shard is above the limit, and no shard is the beginning of another.
    for shard in held:
        parent = sum(b for s, b in held.items() if s.startswith(shard[:-1]))
        assert parent > 4000
        assert not any(s != shard and s.startswith(shard) for s in held)
    assert sharding.assign_shards(empty, 10).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 10) for i in range(500)], "doc_id long, text string")
    directory = sharding.write_shards(docs, str(tmp_path / "out"), 1000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 500 and back.select("__shard").distinct().count() == directory.count()


def test_ids_where_normalising_changes_letters():
    """Capital dotted I, decomposed letters, letters that compose or decompose, whose lower case differs in length: before every mark."""
    import sys
    import unicodedata

    import numpy as np

    library, machine = Tokenizer.from_file(str(WORDS)), packing.CachedTokenizer(str(WORDS))
    assert machine.bare
    odd = [chr(c) for c in range(sys.maxunicode) if not 0xD800 <= c < 0xE000 and (len(chr(c).lower()) != 1 or unicodedata.normalize("NFC", chr(c)) != chr(c))]
    latin = [chr(c) for c in range(0xC0, 0x250)]
    letters = odd[::7] + latin + ["İ", "İ", "é", "Å", "क़", "יִ", "Σ", "ª", "µ"]
    made = ["Bugün PARTİ. Sonra", "PARTİ, ", "don't we'll I'D, x's. 'S", "a.b, c.́ d!? e:", "<|endoftext|>, x<|endoftext|>. <|startoftext|>"]
    made += [f"ab{c}{m} c {c}{m}\n{c}z" for c in letters for m in (".", ",", ";", ":", "!", "?", "...", "", '%$#"', "_-", "'s", "<|", "(a)", "@x.y")]
    expected = [e.ids for e in library.encode_batch(made, add_special_tokens=False)]
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in machine.encode(made)] == expected


def test_every_piece_has_a_place_of_its_own(spark):
    """``place`` against the pieces put one by one where their run says, on any number of partitions."""
    random.seed(3)
    docs = spark.createDataFrame([(i, " ".join(random.choices("abcdefg", k=random.choice([0, 1, 3, 9, 40, 90])))) for i in range(700)], "doc_id long, text string")
    for parts in (1, 6):
        rows = packing.pack(docs.repartition(parts), str(WORDS), capacity=64).collect()
        taken = Counter((r["sequence_id"], r["offset"] + i) for r in rows for i in range(r["length"]))
        assert max(taken.values()) == 1 and all(0 <= at < 64 for _, at in taken)
        assert len({s for s, _ in taken}) <= 1.01 * one_at_a_time([r["length"] for r in rows], 64) + 1
