"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Both tokenizers cut the bytes of a space and the text. Where tokens of both begin at one byte a group
begins, and two tokens are linked where their bytes overlap. The unit of work is a fragment, the tokens
that begin in one range of bytes: an open prefix before the first common beginning, closed groups, and
an open suffix from the last one on. Composing neighbours closes the group that lies between them, in
whatever order fragments are composed. A text of up to LONG bytes is aligned in one task, many short
ones in one pass over arrays. A longer one is cut into pieces where neither tokenizer can join the two
sides; the pieces are dealt over tasks, and a tree of compositions, FAN fragments at a time, puts the
text together.

Counts of linked pairs go over the whole corpus. Every text keeps its different pairs with their
numbers; these are summed by pair. To look the sums up, the most frequent pairs, HOT at most, are
broadcast, and the others are joined: no pair among those has a large share of the links.

Nulls, empty texts and texts whose tokens do not spell them in either tokenizer have no tokens: zeros
and an empty digest. Every row of a table is aligned by itself, repeated ids and rows included; other
columns are not looked at, and an empty table gives no rows. A run without a place to cut is one piece.
"""

import hashlib
import json
import pickle
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyline.llm.common import ship_package
from tallyline.session import written

LONG, PIECE = 1 << 16, 1 << 15
BYTES = 1 << 20  # of texts that are aligned in one pass
FAN = 8
HOT = 1_000_000
WORD_END = "▁"
#: Between such characters every match of a byte-level pattern ends.
BREAK = regex.compile(r"(?<=[\p{L}\p{N}])(?=[^\p{L}\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}\s])")
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def byte_letters():
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level BPE file of the tokenizers library.

    Where every entry of the vocabulary is encoded as itself, merging by the rank of the joined bytes
    takes the same steps as the file's merges: a step that only one of them takes would leave the
    entry it makes in two parts. Then the quicker library encodes.
    """

    def __init__(self, path, pattern):
        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        with open(path, encoding="utf-8") as lines:
            vocab = json.load(lines)["model"]["vocab"]
        byte_of = byte_letters()
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.bytes[i] = bytes(map(byte_of.__getitem__, entry))
        bare = Tokenizer(own.model)
        entries = list(vocab)
        same = all(e.ids == [vocab[s]] for s, e in zip(entries, bare.encode_batch_fast(entries, add_special_tokens=False)))
        if same and set(range(256)) <= {b[0] for b in self.bytes if len(b) == 1}:
            ranks = {b: i for i, b in enumerate(self.bytes) if b}
            quick = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.encode = quick.encode_ordinary
        else:
            self.encode = lambda text: own.encode(text, add_special_tokens=False).ids

    def ids(self, texts):
        return [self.encode(t) for t in texts]


class Pieces:
    """A sentencepiece file, which puts a space before a text."""

    def __init__(self, path):
        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes, self.joined = [], set()
        for i in range(len(self.own)):
            piece = self.own.id_to_piece(i)
            if self.own.is_byte(i):
                self.bytes.append(bytes([int(piece[3:-1], 16)]))
                continue
            self.bytes.append(piece.replace(WORD_END, " ").encode())
            self.joined.update(zip(piece, piece[1:]))
        self.line = self.own.encode("\n")

    def ids(self, texts):
        """Ids of texts that come with their space before them."""
        return self.own.encode([t[1:] for t in texts], num_threads=1)

    def ids_within(self, text):
        """Ids of a piece of a text; one that does not begin with a space and more is read behind a line end."""
        if text.startswith(" ") and len(text) > 1:
            return self.own.encode(text[1:])
        ids = self.own.encode("\n" + text)
        return ids[len(self.line):] if ids[:len(self.line)] == self.line else None

    def apart(self, left, right):
        """Whether no entry joins two neighbouring characters, so that a text may be cut between them."""
        first, second = left.replace(" ", WORD_END), right.replace(" ", WORD_END)
        return (first, second) not in self.joined and ("\n", second) not in self.joined


class Pair:
    """Two tokenizers, the lengths of their tokens in bytes, and how an id is written in the groups."""

    def __init__(self, path_a, pattern, path_b):
        self.a, self.b = ByteLevel(path_a, pattern), Pieces(path_b)
        self.len_a, self.len_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        self.many_b = len(self.b.bytes)
        self.said = [f"{i}{end}".encode() for i in range(max(len(self.a.bytes), self.many_b)) for end in ",|;"]

    def pieces(self, text):
        """Parts of a text, cut about every PIECE characters where both tokenizers cut."""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > PIECE:
                for found in BREAK.finditer(text, at + PIECE):
                    if self.b.apart(text[found.start() - 1], text[found.start()]):
                        end = found.start()
                        break
            yield text[at:end]
            at = end

    def spelt(self, ids_a, ids_b, data):
        """Whether both kinds of ids spell the bytes."""
        return all(b"".join(map(t.bytes.__getitem__, ids)) == data for t, ids in ((self.a, ids_a), (self.b, ids_b)))

    def starts(self, ids_a, ids_b, at=0):
        """First bytes of tokens that cover the same bytes, from `at` on."""
        return [at + np.cumsum(lens[ids]) - lens[ids] for lens, ids in ((self.len_a, ids_a), (self.len_b, ids_b))]

    def code(self, a, b):
        return a * self.many_b + b


@lru_cache(maxsize=2)
def pair_of(path_a, pattern, path_b):
    """One pair for each worker process."""
    return Pair(path_a, pattern, path_b)


def _marks(starts, lo, size):
    marks = np.zeros(size, bool)
    marks[starts - lo] = True
    return marks


def close(pair, a_at, a_id, b_at, b_id):
    """Groups of tokens that begin at one byte in both: (first bytes of groups, their first tokens, texts of tokens, links).

    The texts are in the order of the groups, and the first token of a group is its place among them.
    The links are (first bytes, codes of their pairs).
    """
    lo, size = int(a_at[0]), int(max(a_at[-1], b_at[-1]) - a_at[0]) + 1
    in_a, in_b = _marks(a_at, lo, size), _marks(b_at, lo, size)
    upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
    common = np.flatnonzero(in_a & in_b)
    first_a, first_b = np.append(upto_a[common] - 1, len(a_at)), np.append(upto_b[common] - 1, len(b_at))
    counts_a, counts_b = np.diff(first_a), np.diff(first_b)
    place_a = np.arange(len(a_at)) + np.repeat(first_b[:-1], counts_a)
    place_b = np.arange(len(b_at)) + np.repeat(first_a[1:], counts_b)
    said = np.empty(len(a_at) + len(b_at), np.int64)
    said[place_a], said[place_b] = 3 * a_id, 3 * b_id
    said[place_a[first_a[1:] - 1]] += 1
    said[place_b[first_b[1:] - 1]] += 2
    texts = list(map(pair.said.__getitem__, said.tolist()))
    links = np.flatnonzero(in_a | in_b)
    codes = pair.code(a_id[upto_a[links] - 1], b_id[upto_b[links] - 1])
    return common + lo, (first_a + first_b)[:-1], texts, links + lo, codes


def _summed(codes, times):
    """Different codes, sorted, and the sums of their times."""
    order = np.argsort(codes, kind="stable")
    codes, times = codes[order], times[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1])))
    return codes[new], np.add.reduceat(times, new) if len(new) else times


class Fragment:
    """The tokens that begin in one range of bytes.

    `prefix` and `suffix` are (first bytes and ids of the one, first bytes and ids of the other); a
    fragment without a common beginning is all prefix and has no suffix.
    """

    def __init__(self, prefix, text=b"", sums=(0, 0, 0, 0), codes=None, times=None, suffix=None):
        self.prefix, self.text, self.sums, self.suffix = prefix, text, sums, suffix
        self.codes = np.empty(0, np.int64) if codes is None else codes
        self.times = np.empty(0, np.int64) if times is None else times


def _part(tokens, lo, hi):
    out = []
    for at, ids in zip(tokens[::2], tokens[1::2]):
        here = slice(*np.searchsorted(at, (lo, hi)))
        out += [at[here], ids[here]]
    return tuple(out)


def _beside(x, y):
    return tuple(np.concatenate(z) for z in zip(x, y))


def _closed(pair, tokens):
    """(text, sums, codes, times) of tokens that begin and end at common bytes."""
    groups, _, texts, links, codes = close(pair, *tokens)
    return b"".join(texts), (len(tokens[0]), len(tokens[2]), len(groups), len(links)), *_summed(codes, np.ones(len(codes), np.int64))


def fragment(pair, tokens):
    """The fragment of tokens (a_at, a_id, b_at, b_id) that begin in one range of bytes."""
    common = np.intersect1d(tokens[0], tokens[2], assume_unique=True)
    if not len(common):
        return Fragment(tokens)
    first, last, end = common[0], common[-1], np.iinfo(np.int64).max
    whole = _closed(pair, _part(tokens, first, last)) if first < last else ()
    return Fragment(_part(tokens, 0, first), *whole, suffix=_part(tokens, last, end))


def compose(pair, x, y):
    """The fragment of two neighbouring ranges."""
    if y.suffix is None:
        if x.suffix is None:
            return Fragment(_beside(x.prefix, y.prefix))
        return Fragment(x.prefix, x.text, x.sums, x.codes, x.times, _beside(x.suffix, y.prefix))
    if x.suffix is None:
        return Fragment(_beside(x.prefix, y.prefix), y.text, y.sums, y.codes, y.times, y.suffix)
    text, sums, codes, times = _closed(pair, _beside(x.suffix, y.prefix))
    codes, times = _summed(np.concatenate((x.codes, codes, y.codes)), np.concatenate((x.times, times, y.times)))
    sums = tuple(map(sum, zip(x.sums, sums, y.sums)))
    return Fragment(x.prefix, x.text + text + y.text, sums, codes, times, y.suffix)


def whole(pair, x):
    """(groups as text, sums, codes, times) of the fragment of a whole text."""
    text, sums, codes, times = _closed(pair, x.suffix)
    codes, times = _summed(np.concatenate((x.codes, codes)), np.concatenate((x.times, times)))
    return (x.text + text)[:-1], tuple(map(sum, zip(x.sums, sums))), codes, times


def align_texts(pair, texts):
    """(groups as text, sums, codes, times) for each text, with its space before it; None for one without tokens.

    All texts are aligned as one row of bytes: each begins at a common byte.
    """
    out = [None] * len(texts)
    said = [(i, a, b) for i, a, b in zip(range(len(texts)), pair.a.ids(texts), pair.b.ids(texts))]
    said = [(i, a, b) for i, a, b in said if len(texts[i]) > 1 and pair.spelt(a, b, texts[i].encode())]
    if not said:
        return out
    a_id, b_id = (np.concatenate([np.array(x[k], np.int64) for x in said]) for k in (1, 2))
    a_at, b_at = pair.starts(a_id, b_id)
    groups, first, parts, links, codes = close(pair, a_at, a_id, b_at, b_id)
    n_a, n_b = np.array([len(a) for _, a, _ in said]), np.array([len(b) for _, _, b in said])
    begin = a_at[np.cumsum(n_a) - n_a]
    group = np.append(np.searchsorted(groups, begin), len(groups))
    place = np.append(first, len(parts))[group]
    link = np.append(np.searchsorted(links, begin), len(links))
    for k, (i, _, _) in enumerate(said):
        own = np.sort(codes[link[k]:link[k + 1]])
        new = np.flatnonzero(np.concatenate((np.ones(1, bool), own[1:] != own[:-1])))
        sums = (int(n_a[k]), int(n_b[k]), int(group[k + 1] - group[k]), len(own))
        out[i] = b"".join(parts[place[k]:place[k + 1]])[:-1], sums, own[new], np.diff(np.append(new, len(own)))
    return out


def _batches(texts):
    """Runs of texts of about BYTES bytes, as (first, last)."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or b"")
        if size >= BYTES:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _row(found, keep_groups):
    if found is None:
        return (0, 0, 0, 0, "", [], []) + ("",) * keep_groups
    text, sums, codes, times = found
    return (*sums, hashlib.sha256(text).hexdigest(), codes, times) + (text.decode(),) * keep_groups


def _short(docs, files, id_col, data, keep_groups):
    fields = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<long>"
    names = [*COUNTS, "groups_sha256", "codes", "times"] + ["groups"] * keep_groups

    @F.pandas_udf(fields + ", groups string" * keep_groups)
    def align(texts: pd.Series) -> pd.DataFrame:
        pair, rows = pair_of(*files), []
        for a, b in _batches(texts):
            spaced = [" " + (t or b"").decode("utf-8", "replace") for t in texts[a:b]]
            rows += [_row(found, keep_groups) for found in align_texts(pair, spaced)]
        return pd.DataFrame(rows, columns=names)

    rows = docs.where(F.coalesce(F.octet_length(data), F.lit(0)) <= LONG)
    aligned = rows.select(F.col(id_col), F.monotonically_increasing_id().alias("row_"), align(data).alias("out_"))
    return aligned.select(id_col, "row_", *[F.col(f"out_.{name}").alias(name) for name in names])


def _long_pieces(docs, files, id_col, data):
    """Pieces of the long texts, numbered, with their first bytes."""
    @F.pandas_udf("array<struct<piece:int,start:long,part:binary>>")
    def cut(texts: pd.Series) -> pd.Series:
        pair, out = pair_of(*files), []
        for text in texts:
            rows, start = [], 0
            for n, part in enumerate(pair.pieces(" " + text.decode("utf-8", "replace"))):
                part = part.encode()
                rows.append({"piece": n, "start": start, "part": part})
                start += len(part)
            out.append(rows)
        return pd.Series(out)

    rows = docs.where(F.octet_length(data) > LONG).select(F.col(id_col), (-1 - F.monotonically_increasing_id()).alias("row_"), data.alias("data_"))
    return rows.select(id_col, "row_", F.inline(cut("data_"))).select(id_col, "row_", "piece", "start", "part")


def _fragments(pieces, files):
    """A fragment for each piece; a null one where a tokenizer does not spell the piece."""
    @F.pandas_udf("binary")
    def make(number: pd.Series, start: pd.Series, parts: pd.Series) -> pd.Series:
        pair, out = pair_of(*files), []
        for n, at, data in zip(number, start, parts):
            text = data.decode()
            a, b = pair.a.encode(text), pair.b.ids([text])[0] if n == 0 else pair.b.ids_within(text)
            if b is None or not pair.spelt(a, b, data):
                out.append(None)
                continue
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            a_at, b_at = pair.starts(a, b, at)
            out.append(pickle.dumps(fragment(pair, (a_at, a, b_at, b))))
        return pd.Series(out)

    return pieces.repartition("row_", "piece").select("row_", "piece", make("piece", "start", "part").alias("fragment"))


def _composed(fragments, files):
    """Fragments of FAN neighbours put together."""
    def join(rows):
        rows = rows.sort_values("piece")
        pair, held = pair_of(*files), None
        if rows["fragment"].notna().all():
            parts = [pickle.loads(x) for x in rows["fragment"]]
            while len(parts) > 1:
                parts = [compose(pair, *two) if len(two) > 1 else two[0] for two in (parts[i:i + 2] for i in range(0, len(parts), 2))]
            held = pickle.dumps(parts[0])
        return pd.DataFrame({"row_": rows["row_"].iloc[:1], "piece": rows["piece"].iloc[:1] // FAN, "fragment": [held]})

    groups = fragments.groupBy("row_", (F.col("piece") / FAN).cast("int").alias("group_"))
    return groups.applyInPandas(join, "row_ long, piece int, fragment binary")


def _long(docs, files, id_col, data, keep_groups):
    pieces = written(_long_pieces(docs, files, id_col, data), "alignment-pieces")
    last = pieces.agg(F.max("piece")).first()[0]
    fragments = written(_fragments(pieces, files), "alignment-fragments")
    while last:
        fragments, last = written(_composed(fragments, files), "alignment-composed"), last // FAN
    fields = "row_ long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<long>"
    names = ["row_", *COUNTS, "groups_sha256", "codes", "times"] + ["groups"] * keep_groups

    def finish(batches):
        pair = pair_of(*files)
        for batch in batches:
            found = [None if x is None else whole(pair, pickle.loads(x)) for x in batch["fragment"]]
            rows = [(row, *_row(x, keep_groups)) for row, x in zip(batch["row_"], found)]
            yield pd.DataFrame(rows, columns=names)

    done = fragments.select("row_", "fragment").mapInPandas(finish, fields + ", groups string" * keep_groups)
    return pieces.where("piece = 0").select(id_col, "row_").join(done, "row_").select(id_col, *names)


def aligned(docs, files, id_col="doc_id", text_col="text", keep_groups=False):
    """A row per text: `row_`, its numbers, its groups' digest (and the groups), its pairs' codes and times; written once.

    `files` are the byte-level file, its pattern, and the sentencepiece file. A code is the first id
    times the size of the second vocabulary, and the second id.
    """
    ship_package(docs.sparkSession)
    data = F.col(text_col).cast("string").cast("binary")
    short = written(_short(docs, files, id_col, data, keep_groups), "alignment-short")
    return short.unionByName(_long(docs, files, id_col, data, keep_groups))


def pair_counts(rows, many_b):
    """Numbers of links of each linked pair of ids over all rows of `aligned`: code, count, and whether it is its second id's highest."""
    links = rows.select(F.inline(F.arrays_zip("codes", "times")))
    counts = written(links.groupBy("codes").agg(F.sum("times").alias("count")), "alignment-counts")
    second = F.col("codes") % many_b
    best = counts.groupBy(second.alias("second")).agg(F.max("count").alias("highest"))
    return written(
        counts.join(best, second == F.col("second")).select("codes", "count", (F.col("count") == F.col("highest")).alias("best")),
        "alignment-best",
    )


def _hot(counts):
    """The counts from the least one on that not more than HOT pairs reach, as arrays, and that count."""
    step = F.floor(F.log2(F.col("count").cast("double")) * 8).cast("int")
    steps = sorted(((r.step, r.n) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    taken, least = 0, None
    for at, n in steps:
        if taken + n > HOT:
            break
        taken, least = taken + n, at
    chosen = F.lit(False) if least is None else step >= least
    rows = counts.where(chosen).toPandas().sort_values("codes")
    arrays = [rows["codes"].to_numpy(np.int64), rows["count"].to_numpy(np.int64), rows["best"].to_numpy(bool)]
    return arrays, chosen, taken == sum(n for _, n in steps)


def with_counts(rows, counts):
    """Rows of `aligned` with `n_best`, the links whose pair is its second id's most frequent, and `count_sum`, the counts of all their pairs."""
    spark = rows.sparkSession
    arrays, hot, every = _hot(counts)
    known = spark.sparkContext.broadcast(arrays)

    @F.pandas_udf("best_ long, sum_ long, codes_ array<long>, times_ array<long>")
    def look_up(codes: pd.Series, times: pd.Series) -> pd.DataFrame:
        keys, counted, best = known.value
        out = []
        for code, n in zip(codes, times):
            at = np.minimum(np.searchsorted(keys, code), max(len(keys) - 1, 0))
            found = keys[at] == code if len(keys) else np.zeros(len(code), bool)
            at, seen = at[found], n[found]
            out.append((int(seen[best[at]].sum()) if len(at) else 0, int((seen * counted[at]).sum()) if len(at) else 0, code[~found], n[~found]))
        return pd.DataFrame(out, columns=["best_", "sum_", "codes_", "times_"])

    found = rows.withColumn("of_", look_up("codes", "times"))
    if every:
        return found.withColumns({"n_best": F.col("of_.best_"), "count_sum": F.col("of_.sum_")}).drop("of_")
    found = written(found, "alignment-hot")
    rest = found.select("row_", F.inline(F.arrays_zip(F.col("of_.codes_").alias("codes"), F.col("of_.times_").alias("times"))))
    rest = rest.join(counts.where(~hot), "codes").groupBy("row_").agg(
        F.sum(F.when(F.col("best"), F.col("times"))).alias("more_best_"), F.sum(F.col("times") * F.col("count")).alias("more_")
    )
    zero = F.lit(0).cast("long")
    return found.join(rest, "row_", "left").withColumns({
        "n_best": F.col("of_.best_") + F.coalesce("more_best_", zero), "count_sum": F.col("of_.sum_") + F.coalesce("more_", zero),
    }).drop("of_", "more_best_", "more_")


def alignment(docs, files, id_col="doc_id", text_col="text"):
    """`id_col`, the numbers of tokens, groups and links of each text, `n_best`, `count_sum` and `groups_sha256`."""
    rows = aligned(docs, files, id_col, text_col)
    counts = pair_counts(rows, pair_of(*files).many_b)
    return with_counts(rows, counts).select(id_col, *COUNTS, "n_best", "count_sum", "groups_sha256")
