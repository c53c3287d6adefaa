"""Operators 11 to 13 against the tiktoken library and plain Python versions."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from leafscan.llm import byte_bpe, fill_middle, pii, spelling, units

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["ids", "decoded", "frames", "ends", "n", "form", "word", "root", "key", "run", "low", "marked"]
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def documents(spark, rows):
    full = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).select("*", *[F.lit(7).alias(c) for c in CLASHING])


def odd_rows():
    long_text = " ".join(f"lengthy{chr(97 + i % 26)}word {i % 977}\n" for i in range(20_000))
    return [
        (1, "Alpha beta gamma"),
        (2, "Alpha beta gamma"),
        (2, "Alpha beta gamma"),
        (3, None),
        (None, "elsewhere elsewhere"),
        (4, ""),
        (5, "   \n\t "),
        (6, long_text),
        (7, long_text + "<P>"),
        (8, "\U0001f600É é ÉTÉ 漢字" * 3),
        (9, "a<S>b"),
        (10, "<M>"),
        (11, "x" * 40_000),
        (12, "<|endoftext|> don't 'tis"),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, odd_rows()).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


# --- 11 byte-level BPE -------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(RANKS, PATTERN)


PARTS = [" ", "  ", "\n", "\t", "\xa0", "\x1c", "　", "a", "B", "é", "'s", "'", "'re", "1", "²", "漢字", "!", "<|endoftext|>", "\r\n", "​", "don't", "\x85", "x" * 70,
         "×", "÷", "À", "\x00", "\U0001f600", "the", "tion", "Привет", "(", "--", "\n\n", " \n"]


def test_ids_equal_the_library(encoder, library):
    rng = random.Random(1)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(6000)] + ["", "x" * 3000, "ab" * 2000, " " * 700, "漢" * 900]
    for _ in range(2):  # new units, then remembered ones
        ids, bounds = encoder.units.encode(pa.array(texts))
        for i, text in enumerate(texts):
            own = ids[bounds[i] : bounds[i + 1]]
            assert own.tolist() == library.encode_ordinary(text), repr(text)
            assert encoder.ranks.decode(own).tobytes() == text.encode()


def test_trees_merge_leftmost_least_pairs(encoder):
    ranks = encoder.ranks

    def merged(piece):
        if piece in ranks.ids:
            return [ranks.ids[piece]]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((ranks.ids[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks.ids), default=None)
            if best is None:
                return [ranks.ids[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rng = random.Random(2)
    pieces = [bytes(rng.choices(b"aethinos \xc3\xa9", k=rng.randint(1, 40))) for _ in range(3000)] + [b"a", b"aaaa" * 33, bytes(range(256))]
    for piece, ids in zip(pieces, ranks.merge(pieces), strict=True):
        assert ids.tolist() == merged(piece), piece


def test_units_do_not_depend_on_windows_or_memory(encoder, monkeypatch):
    rng = random.Random(3)
    texts = pa.array(["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(400)])
    want = encoder.units.encode(texts)
    for name, value in (("UNITS_AT_ONCE", 17), ("HELD_UNITS", 5)):
        monkeypatch.setattr(units, name, value)
        for got, full in zip(encoder.units.encode(texts), want, strict=True):
            assert np.array_equal(got, full)
    part = encoder.units.encode(texts[100:300])  # a slice of a larger array
    assert np.array_equal(part[0], want[0][want[1][100] : want[1][300]])


def test_byte_bpe(spark, odd, empty, library):
    got = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(odd, RANKS, PATTERN), RANKS, PATTERN))
    want = []
    for i, text in odd_rows():
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(empty, RANKS, PATTERN), RANKS, PATTERN)).count() == 0


# --- 12 spelling variants ------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, dominant=10):
    form = {}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= dominant * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] is not None else None))
    return out


def vocabulary(rng, letters, size, shortest, longest):
    words = {"".join(rng.choices(letters, k=rng.randint(shortest, longest))) for _ in range(size)}
    for w in list(words):
        for _ in range(rng.randint(0, 3)):
            i, c = rng.randrange(len(w) + 1), rng.choice(letters)
            words.add(rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]]))
    return {w: 10 ** rng.randint(0, 5) + rng.randint(0, 3) for w in words if len(w) >= shortest}


@pytest.mark.parametrize(("letters", "size", "shortest", "longest"), [("ab", 300, 7, 9), ("abcé", 250, 1, 6), ("aeioüß\U0001f600", 150, 7, 90)])
@pytest.mark.parametrize("group", [1024, 16])
def test_variants(spark, monkeypatch, letters, size, shortest, longest, group):
    """Small groups cut most keys into slices, of which every pair is compared."""
    monkeypatch.setattr(spelling, "GROUP_WORDS", group)
    counts = vocabulary(random.Random(size), letters, size, shortest, longest)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.variants(words, shortest).collect()
    assert len(got) == len(counts)
    assert set(map(tuple, got)) == brute_variants(counts)


def test_long_chains_and_ties(spark):
    chain = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb", "aabbbbb", "abbbbbb"]
    counts = {w: 2 * 10**i for i, w in enumerate(chain)} | {"zzzzzzz": 3, "zzzzzzy": 40, "zzzzzzx": 40}
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), 7).collect()}
    assert {got[w].root for w in chain} == {"abbbbbb"}
    assert (got["zzzzzzz"].form, got["zzzzzzz"].n_near, got["zzzzzzx"].form) == ("zzzzzzx", 2, None)
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_very_long_words(spark):
    word = "ab" * 20_000
    counts = {word: 100, word + "c": 2, word[1:]: 3, word[:500] + "c" + word[501:]: 4, word[:-2] + "zz": 5}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), 7).collect()
    assert {r.word: r.n_near for r in got} == {w: sum(one_edit(w, v) for v in counts) for w in counts}


def brute_counts(rows, every, least_chars, least_count):
    lower = {c: c + 32 for c in range(65, 91)}
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_count}


def test_noisy_counts(spark, odd, empty):
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choices("abÉé", k=rng.randint(1, 9))) for _ in range(200))) for i in range(60)]
    for table, own in ((documents(spark, rows), rows), (odd, odd_rows())):
        got = {r.word: r.n for r in spelling.noisy_counts(table, 5, 4, 2).collect()}
        assert got == brute_counts(own, 5, 4, 2)
    assert spelling.noisy_counts(empty, 5, 4, 2).count() == 0


# --- 13 fill in the middle -------------------------------------------------------------


def brute_middle(i, text):
    text = text or ""
    n, digest = len(text), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, n, "plain", None, None, text
    if h4 % 100 < 20:
        return i, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return i, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


@pytest.mark.parametrize("size", [7, 1 << 14])
def test_frames_give_spans_and_markers(monkeypatch, size):
    monkeypatch.setattr(fill_middle, "FRAME_UNITS", size)
    rng = random.Random(size)
    for i in range(400):
        text = "".join(rng.choices(["a", "é", "漢", "\U0001f600", "<", "P", ">", "<S", "P>", "\n"], k=rng.randint(0, 60)))
        stored = fill_middle.Frames()
        stored.add(text)
        a, b = sorted((rng.randint(0, len(text)), rng.randint(0, len(text))))
        assert b"".join(stored.read(a, b)).decode() == text[a:b]
        assert stored.find("<P>", a) == text.find("<P>", a)
        if any(m in text for m in ("<P>", "<S>", "<M>")):
            continue
        for form in ("psm", "spm", "plain"):
            out = stored.rearranged(fill_middle.order(form, len(text), (a, b)))
            whole = b"".join(out.read(0, out.units)).decode()
            assert whole == {"psm": f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", "spm": f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}", "plain": text}[form]
            assert "".join(b"".join(out.read(*s)).decode() for s in fill_middle.restored(out, form)) == text


def test_whole_frames_are_taken_over_without_decompression(monkeypatch):
    monkeypatch.setattr(fill_middle, "FRAME_UNITS", 100)
    stored = fill_middle.Frames()
    stored.add("".join(random.Random(8).choices("abcdefgh", k=5000)))
    read = []
    plain = fill_middle.Frames.text
    monkeypatch.setattr(fill_middle.Frames, "text", lambda self, k: read.append(k) or plain(self, k))
    out = stored.rearranged(fill_middle.order("psm", 5000, (1234, 3456)))
    assert set(read) == {12, 34}
    assert len(set(out.frames) & set(stored.frames)) == 48  # all but the two that hold a cut


def test_fill_middle(spark, odd, empty):
    rng = random.Random(6)
    rows = odd_rows() + [(100 + i, "".join(rng.choices("aé \n<漢", k=rng.randint(1, 300)))) for i in range(300)]
    outputs = fill_middle.transform(fill_middle.store(documents(spark, rows))).persist()
    want = Counter(brute_middle(*r) for r in rows)
    got = Counter()
    for r in outputs.collect():
        text = fill_middle.Frames(r.frames, r.ends)
        got[(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, b"".join(text.read(0, text.units)).decode())] += 1
    assert got == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    hashed = Counter(map(tuple, fill_middle.digests(outputs).collect()))
    texts = Counter((i, len(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert Counter((r[0], r[1], r[6]) for r in hashed.elements()) == texts
    assert Counter(r[:6] for r in hashed.elements()) == Counter((*r[:5], hashlib.sha256(r[5].encode()).hexdigest()) for r in want.elements())
    assert fill_middle.digests(fill_middle.transform(fill_middle.store(empty))).count() == 0


# --- 6 surrogates: names, domains, accounts -------------------------------------------------


def replaced(spark, *texts, key="k"):
    rows = documents(spark, list(enumerate(texts)))
    return [r for r in pii.replace_pii(rows, key).orderBy("doc_id").collect()]


def test_surnames_are_replaced_wherever_they_stand(spark):
    a, b = replaced(spark, "Mr. Alex Smith came. Smith said that Smith's dog, blacksmith and smith stay. SMITH!", "Smith is no known name here")
    new = re.match(r"Mr\. (\w+) (\w+) came", a.text)
    surname = new[2]
    assert surname != "Smith" and "Smith" not in a.text.replace("blacksmith", "")
    assert f"{surname} said that {surname}'s dog, blacksmith and smith stay. {surname.upper()}!" in a.text
    assert b.text == "Smith is no known name here" and (a.n_surname, a.n_given) == (4, 1)


def test_a_given_name_is_one_entity_under_any_title(spark):
    rows = replaced(spark, "Mr. Alex Smith", "Dr. Alex Smith", "Prof Alex Jones", "Mrs Maria Jones")
    given = [re.search(r"(\w+) \w+$", r.text)[1] for r in rows]
    assert len(set(given[:3])) == 1 and given[0].endswith("n") and given[3].endswith("ia")


def iban_valid(text):
    moved = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in moved[4:] + moved[:4])) % 97 == 1


def test_accounts_and_long_addresses(spark):
    own = ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "2001:db8:85a3::8a2e:370:7334", "fe80:0:0:0:202:b3ff:fe1e:8329", "::1"]
    rows = replaced(spark, *[f"see {v} now" for v in own], "std::vector at 12:30:45 add::face")
    got = [r.text[4:-4] for r in rows[:5]]
    assert all(a != b and re.sub(r"[0-9A-Za-z]", "x", a) == re.sub(r"[0-9A-Za-z]", "x", b) for a, b in zip(own, got, strict=True))
    assert iban_valid(got[0]) and iban_valid(got[1]) and got[0][:2] == "DE" and got[1][:2] == "GB"
    assert [r.n_iban for r in rows] == [1, 1, 0, 0, 0, 0] and [r.n_ip6 for r in rows] == [0, 0, 1, 1, 1, 0]
    assert rows[5].text == "std::vector at 12:30:45 add::face"


def test_domains_stay_distinct_and_local_parts_change(spark):
    texts = [f"{local}@{domain}" for local in ("b", "ann", "_") for domain in ("x.com", "y.com", "mail.x.com", "x.org")]
    rows = replaced(spark, *texts)
    new = [r.text.split("@") for r in rows]
    domains = {}
    for text, (local, domain) in zip(texts, new, strict=True):
        old_local, old_domain = text.split("@")
        assert local != old_local and domain != old_domain and "example" in domain
        assert domains.setdefault(old_domain, domain) == domain
    assert len(set(domains.values())) == 4 and len({r.text for r in rows}) == len(texts)


def test_copies_of_one_text(spark):
    """A hot text is dealt over tasks and still gets the same surrogates."""
    texts = ["Mr. Alex Smith, alex@x.com"] * 300 + [f"Mrs. Name{i} Other, call +1 555 123 {i:04d}" for i in range(100)]
    rows = replaced(spark, *texts)
    assert len(rows) == 400 and len({r.text for r in rows[:300]}) == 1 and len({r.text for r in rows}) >= 100
