"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A document is the set of its word shingles; two documents link when their Jaccard similarity is at
least 0.75, so each holds T = ceil(0.75 n) shingles of the other. The search runs in these steps:

1. Inverted lists. Slices of documents ("homes") send each shingle once, packed in buckets by its
   leading bits; a bucket finds the shingles of several documents and answers the homes. Documents
   with fewer than T such shingles have no partner and leave.
2. Equal sets become one class, kept under the hash of the set.
3. Short lists. The lists of classes are built likewise. A list of at most ``SHORT`` classes comes
   back whole, a longer one with its first ``SHORT`` classes. A home merges the lists of each of its
   classes and counts occurrences: a pair counted often enough is a proven link. A class without
   long lists is done.
4. The s - T + 1 rarest shingles of an open class hold one of every partner's. Classes with lists
   of these that hold several components count occurrences with the most central class of each
   component in their lists, which joins groups around their originals.
5. Long lists are probed, not merged: classes of different components that still meet in a list of
   a rarest shingle, with room for the overlap they need from there on, are verified by binary
   search of one sorted set in the other.

A shingle in very many documents costs one entry per home, and a large group of near copies hangs
on the first classes of its lists, so no list is expanded into its pairs.

Defined cases: a null or empty text, or one without words, has no shingles and links with nothing;
a text of fewer than five words has one shingle; null ids take part and never are the smallest;
repeated rows and ids are separate members of one class; an empty table gives an empty result; only
the id and text columns are read, so other columns cannot clash. Shingles are told apart by 48
bits of hash or more, and sets by 64.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilbus.llm import packed
from vigilbus.llm.columns import boxed, unboxed
from vigilbus.llm.components import components
from vigilbus.llm.shingles import shingle_sets
from vigilbus.session import cut_lineage

#: Text, or sets, in bytes of a home slice; rows of one at most.
HOME_BYTES = 2 << 20
HOME_ROWS = 50_000
#: Text in bytes for which there is one bucket.
BUCKET_BYTES = 4 << 20
SHORT = 8
#: Rounds of step 4; what they do not join, step 5 finds.
HUB_ROUNDS = 1
LOW_BITS = 40


def _low(tokens: np.ndarray) -> tuple[bytes, bytes]:
    """The low 40 bits as 4 bytes and 1 byte each."""
    return (tokens.astype(np.uint32).tobytes(),
            ((tokens >> np.uint64(32)) & np.uint64(255)).astype(np.uint8).tobytes())


def _tokens(lo: bytes, hi: bytes, bucket: int) -> np.ndarray:
    return (np.frombuffer(lo, np.uint32).astype(np.uint64)
            | np.frombuffer(hi, np.uint8).astype(np.uint64) << np.uint64(32)
            | np.uint64(bucket << LOW_BITS))


def _width(bits: int) -> int:
    return (bits + LOW_BITS + 7) // 8


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts as bytes where they fit, after a byte that names their size."""
    kind = np.uint8 if counts.max(initial=0) < 256 else np.uint32
    return bytes([kind().itemsize]) + counts.astype(kind).tobytes()


def _unpack_counts(body: bytes) -> np.ndarray:
    return np.frombuffer(body, {1: np.uint8, 4: np.uint32}[body[0]], offset=1).astype(np.int64)


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema)


def _binary(table: pa.Table, name: str, i: int) -> bytes:
    return table.column(name)[i].as_py() or b""


# Step 1: documents to buckets and back.
_SENT = pa.schema([
    ("g", pa.int64()), ("home", pa.int64()), ("lo", pa.binary()), ("hi", pa.binary()),
    ("member", pa.binary()), ("ids", pa.binary()), ("nulls", pa.binary()), ("marks", pa.binary()), ("sizes", pa.binary()),
    ("sets", pa.binary()), ("own", pa.binary()), ("own_member", pa.binary())])
_SENT_SQL = ("g long, home long, lo binary, hi binary, member binary, ids binary, nulls binary, "
             "marks binary, sizes binary, sets binary, own binary, own_member binary")
_ANSWER = pa.schema([
    ("home", pa.int64()), ("bucket", pa.int64()), ("lo", pa.binary()), ("hi", pa.binary()),
    ("member", pa.binary()), ("ids", pa.binary()), ("nulls", pa.binary()), ("marks", pa.binary()), ("sizes", pa.binary()),
    ("sets", pa.binary()), ("own", pa.binary()), ("own_member", pa.binary())])
_ANSWER_SQL = ("home long, bucket long, lo binary, hi binary, member binary, ids binary, "
               "nulls binary, marks binary, sizes binary, sets binary, own binary, own_member binary")
_DOCS = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()),
                   ("active", pa.bool_()), ("tokens", pa.binary())])
_DOCS_SQL = "doc_id long, mark long, n long, cid long, active boolean, tokens binary"


def _send_documents(bits: int, width: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinal = 0
        for batch in batches:
            ids, texts, marks = batch.columns
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for a, b in packed.slices(sizes, HOME_BYTES, HOME_ROWS):
                rows = _document_rows(
                    ids[a:b].to_pylist(), marks[a:b].to_numpy(),
                    shingle_sets(texts[a:b].to_pylist(), width), bits, packed.home_number(ordinal))
                ordinal += 1
                yield from _table(rows, _SENT).to_batches()

    return send


def _document_rows(
    ids: list, marks: np.ndarray, sets: list[np.ndarray], bits: int, home: int
) -> list[dict]:
    sizes = np.array([len(s) for s in sets], np.int32)
    cids = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64)
    tokens = np.concatenate(sets)
    tokens = ((tokens >> np.uint64(64 - bits)) << np.uint64(LOW_BITS)) | (
        tokens & np.uint64((1 << LOW_BITS) - 1))
    member = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, member = tokens[order], member[order]
    starts, many = packed.runs(tokens)
    several = np.repeat(many > 1, many)
    # The last of the senders stands for several documents of this home.
    sent, sender = tokens[starts], np.where(many > 1, len(sets), member[starts]).astype(np.int64)
    rows = [{
        "g": -1 - home, "home": home,
        "ids": np.array([i or 0 for i in ids], np.int64).tobytes(),
        "nulls": np.array([i is None for i in ids], np.uint8).tobytes(),
        "marks": marks.tobytes(), "sizes": sizes.tobytes(), "sets": cids.tobytes(),
        "own": tokens[several].tobytes(), "own_member": member[several].tobytes()}]
    cuts = np.searchsorted(
        sent, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(LOW_BITS)).tolist()
    for bucket in range(1 << bits):
        a, b = cuts[bucket], cuts[bucket + 1]
        if b > a:
            by = np.argsort(sender[a:b], kind="stable")
            lo, hi = _low(sent[a:b][by])
            rows.append({"g": bucket, "home": home, "lo": lo, "hi": hi, "member": _pack_counts(
                np.bincount(sender[a:b], minlength=len(sets) + 1))})
    return rows


def _shared_in_bucket(key: tuple, table: pa.Table) -> pa.Table:
    """Of a bucket: the tokens of several documents, sent back to the homes of their documents.
    A home's own row passes through."""
    g = key[0].as_py()
    if g < 0:
        out = table.drop_columns(["g"]).add_column(1, "bucket", pa.nulls(len(table), pa.int64()))
        return out.select(_ANSWER.names).cast(_ANSWER)
    homes = table.column("home").to_pylist()
    tokens = [_tokens(_binary(table, "lo", i), _binary(table, "hi", i), 0)
              for i in range(len(homes))]
    counts = [_unpack_counts(_binary(table, "member", i)) for i in range(len(homes))]
    members = [np.repeat(np.arange(len(c)), c) for c in counts]
    every = np.concatenate(tokens)
    order = np.argsort(every, kind="stable")
    starts, many = packed.runs(every[order])
    marked = np.concatenate([m == len(c) - 1 for m, c in zip(members, counts, strict=True)])[order]
    shared_runs = (many > 1) | np.logical_or.reduceat(marked, starts)
    shared = np.empty(len(every), bool)
    shared[order] = np.repeat(shared_runs, many)
    rows, at = [], 0
    for home, token, member, count in zip(homes, tokens, members, counts, strict=True):
        keep = shared[at:at + len(token)] & (member != len(count) - 1)
        at += len(token)
        if keep.any():
            lo, hi = _low(token[keep])
            rows.append({"home": home, "bucket": g, "lo": lo, "hi": hi,
                         "member": _pack_counts(np.bincount(
                             member[keep], minlength=len(count) - 1))})
    return _table(rows, _ANSWER)


def _needed(n: np.ndarray | int):
    """Shingles that a set of n shares with any partner: ceil(0.75 n)."""
    return (3 * n + 3) // 4


def _prune(bits: int):
    return lambda table: _prune_home(table, _width(bits))


def _prune_home(table: pa.Table, width: int) -> pa.Table:
    """A row per document; the shared tokens of those that have enough, once for equal sets."""
    tokens, members, rows = [], [], []
    for i, bucket in enumerate(table.column("bucket").to_pylist()):
        if bucket is None:
            ids = np.frombuffer(_binary(table, "ids", i), np.int64).tolist()
            nulls = np.frombuffer(_binary(table, "nulls", i), np.uint8).tolist()
            marks = np.frombuffer(_binary(table, "marks", i), np.int64).tolist()
            sizes = np.frombuffer(_binary(table, "sizes", i), np.int32)
            cids = np.frombuffer(_binary(table, "sets", i), np.int64).tolist()
            tokens.append(np.frombuffer(_binary(table, "own", i), np.uint64))
            members.append(np.frombuffer(_binary(table, "own_member", i), np.uint16))
        else:
            tokens.append(_tokens(_binary(table, "lo", i), _binary(table, "hi", i), bucket))
            counts = _unpack_counts(_binary(table, "member", i))
            members.append(np.repeat(np.arange(len(counts), dtype=np.uint16), counts))
    token, member = np.concatenate(tokens), np.concatenate(members)
    token = token[np.lexsort((token, member))]
    many = np.bincount(member, minlength=len(ids))
    active = (many >= _needed(sizes)) & (sizes > 0)
    ends = np.cumsum(many)
    carried: set[int] = set()
    for i, (doc, null) in enumerate(zip(ids, nulls, strict=True)):
        body = None
        if active[i] and cids[i] not in carried:
            carried.add(cids[i])
            body = packed.cut(token[ends[i] - many[i]:ends[i]], width)
        rows.append({"doc_id": None if null else doc, "mark": marks[i], "n": int(sizes[i]),
                     "cid": cids[i], "active": bool(active[i]), "tokens": body})
    return _table(rows, _DOCS)


# Step 3: classes to buckets and back.
_CLASS_SENT = pa.schema([
    ("g", pa.int64()), ("home", pa.int64()), ("lo", pa.binary()), ("hi", pa.binary()),
    ("many", pa.binary()), ("member", pa.binary()), ("cids", pa.binary()), ("sizes", pa.binary()),
    ("counts", pa.binary()), ("tokens", pa.binary())])
_CLASS_SENT_SQL = ("g long, home long, lo binary, hi binary, many binary, member binary, "
                   "cids binary, sizes binary, counts binary, tokens binary")
_LISTS = pa.schema([
    ("home", pa.int64()), ("bucket", pa.int64()), ("lo", pa.binary()), ("hi", pa.binary()),
    ("many", pa.binary()), ("refs", pa.binary()), ("cids", pa.binary()), ("sizes", pa.binary()),
    ("counts", pa.binary()), ("tokens", pa.binary())])
_LISTS_SQL = ("home long, bucket long, lo binary, hi binary, many binary, refs binary, "
              "cids binary, sizes binary, counts binary, tokens binary")
_CLASSES = pa.schema([
    ("ref", pa.int64()), ("cid", pa.int64()), ("n", pa.int64()),
    ("s", pa.int64()), ("near", pa.list_(pa.struct([("ref", pa.int64()), ("shared", pa.int64())]))),
    ("open", pa.bool_()), ("centre", pa.float64()), ("tokens", pa.binary()),
    ("rare", pa.list_(pa.int64()))])
_CLASSES_SQL = ("ref long, cid long, n long, s long, near array<struct<ref:long,shared:long>>, "
                "open boolean, centre double, tokens binary, rare array<long>")


def _send_classes(bits: int, short: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinal = 0
        for batch in batches:
            cids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bodies = batch.column(2)
            for a, b in packed.slices(pc.binary_length(bodies).to_pylist(), HOME_BYTES, HOME_ROWS):
                home = packed.home_number(ordinal)
                ordinal += 1
                sets = [packed.uncut(x, _width(bits)) for x in bodies[a:b].to_pylist()]
                counts = np.array([len(s) for s in sets], np.int32)
                every = np.concatenate(sets)
                member = np.repeat(np.arange(b - a, dtype=np.uint16), counts)
                order = np.argsort(every, kind="stable")
                starts, many = packed.runs(every[order])
                unique = every[order][starts]
                rank = np.arange(len(every)) - np.repeat(starts, many)
                first = member[order][rank < short]
                held = np.minimum(many, short)
                ends = np.cumsum(held)
                rows = [{"g": -1 - home, "home": home, "cids": cids[a:b].tobytes(),
                         "sizes": sizes[a:b].tobytes(), "counts": counts.tobytes(),
                         "tokens": packed.cut(every, _width(bits))}]
                cuts = np.searchsorted(unique, np.arange(
                    (1 << bits) + 1, dtype=np.uint64) << np.uint64(LOW_BITS)).tolist()
                for bucket in range(1 << bits):
                    x, y = cuts[bucket], cuts[bucket + 1]
                    if y > x:
                        lo, hi = _low(unique[x:y])
                        rows.append({
                            "g": bucket, "home": home, "lo": lo, "hi": hi,
                            "many": many[x:y].astype(np.uint16).tobytes(),
                            "member": first[ends[x] - held[x]:ends[y - 1]].tobytes()})
                yield from _table(rows, _CLASS_SENT).to_batches()

    return send


def _lists(short: int):
    return lambda key, table: _lists_of_bucket(key, table, short)


def _lists_of_bucket(key: tuple, table: pa.Table, short: int) -> pa.Table:
    """The lists of a bucket's tokens, whole or their first classes, for each home that asked.

    Classes are named by home and place in it. A list that holds one class is not sent.
    """
    g = key[0].as_py()
    if g < 0:
        out = table.drop_columns(["g", "member"])
        out = out.add_column(1, "bucket", pa.nulls(len(table), pa.int64()))
        out = out.append_column("refs", pa.nulls(len(table), pa.binary()))
        return out.select(_LISTS.names).cast(_LISTS)
    order = np.argsort(table.column("home").to_numpy(), kind="stable").tolist()
    homes = [table.column("home")[i].as_py() for i in order]
    tokens = [_tokens(_binary(table, "lo", i), _binary(table, "hi", i), 0) for i in order]
    many = [np.frombuffer(_binary(table, "many", i), np.uint16).astype(np.int64) for i in order]
    refs = [np.frombuffer(_binary(table, "member", i), np.uint16).astype(np.int64) + (h << 16)
            for i, h in zip(order, homes, strict=True)]
    every, total = np.concatenate(tokens), np.concatenate(many)
    held = np.minimum(total, short)
    entry_token, entry_ref = np.repeat(every, held), np.concatenate(refs)
    by_token = np.argsort(entry_token, kind="stable")  # refs stay in the order of homes
    starts, lengths = packed.runs(entry_token[by_token])
    names = entry_token[by_token][starts]
    lists = entry_ref[by_token]
    place = np.searchsorted(names, every)
    df = np.bincount(place, weights=total, minlength=len(names)).astype(np.int64)
    rows, at = [], 0
    for home, token in zip(homes, tokens, strict=True):
        where = place[at:at + len(token)]
        at += len(token)
        keep = df[where] > 1
        where = where[keep]
        if not len(where):
            continue
        size = np.minimum(lengths[where], short)
        index = np.repeat(starts[where] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        lo, hi = _low(token[keep])
        rows.append({"home": home, "bucket": g, "lo": lo, "hi": hi,
                     "many": np.minimum(df[where], 2**31 - 1).astype(np.int32).tobytes(),
                     "refs": lists[index].tobytes()})
    return _table(rows, _LISTS)


def _merge(bits: int, short: int):
    return lambda table: _merge_home(table, _width(bits), short)


def _merge_home(table: pa.Table, width: int, short: int) -> pa.Table:
    """Counts occurrences in the lists of each class; see step 3 of the module.

    An open class also gets its centre, the mean logarithm of its lists' lengths: copies that many
    others were made from come out highest.
    """
    names, df, refs = [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for i, bucket in enumerate(table.column("bucket").to_pylist()):
        if bucket is None:
            home = table.column("home")[i].as_py()
            cids = np.frombuffer(_binary(table, "cids", i), np.int64).tolist()
            sizes = np.frombuffer(_binary(table, "sizes", i), np.int64)
            counts = np.frombuffer(_binary(table, "counts", i), np.int32)
            every = packed.uncut(_binary(table, "tokens", i), width)
        else:
            names.append(_tokens(_binary(table, "lo", i), _binary(table, "hi", i), bucket))
            df.append(np.frombuffer(_binary(table, "many", i), np.int32))
            refs.append(np.frombuffer(_binary(table, "refs", i), np.int64))
    name, many, ref = np.concatenate(names), np.concatenate(df), np.concatenate(refs)
    held = np.minimum(many, short).astype(np.int64)
    starts = np.cumsum(held) - held
    order = np.argsort(name, kind="stable")
    name, many, held, starts = name[order], many[order], held[order], starts[order]
    rows, end = [], 0
    for i, (cid, n, count) in enumerate(zip(cids, sizes.tolist(), counts.tolist(), strict=True)):
        own = every[end:end + count]
        end += count
        me, need = (home << 16) + i, _needed(n)
        place = np.searchsorted(name, own)
        found = place < len(name)
        found[found] = name[place[found]] == own[found]
        own, place = own[found], place[found]
        near, is_open, body, rare, centre = [], False, None, None, None
        if len(own) >= need:
            size = held[place]
            long = many[place] > short
            index = np.repeat(starts[place] - (np.cumsum(size) - size), size)
            met = ref[index + np.arange(len(index))]
            partner, seen = np.unique(met, return_counts=True)
            close = (seen >= need) & (partner != me)
            near = [{"ref": r, "shared": s} for r, s in
                    zip(partner[close].tolist(), seen[close].tolist(), strict=True)]
            if long.any():
                whole, times = np.unique(met[np.repeat(~long, size)], return_counts=True)
                most = times[whole != me].max(initial=0)
                is_open = bool(long.sum() + most >= need)
        if is_open:
            body = packed.cut(own, width)
            centre = float(np.log2(many[place]).sum()) / n
            rarest = np.lexsort((own, many[place]))[:len(own) - need + 1]
            rare = own[rarest].astype(np.int64).tolist()
        rows.append({"ref": me, "cid": cid, "n": n, "s": len(own), "near": near, "open": is_open,
                     "centre": centre, "tokens": body, "rare": rare})
    return _table(rows, _CLASSES)


# Step 4: central classes of the long lists, one per component.
_HUB_SENT = pa.schema([
    ("g", pa.int64()), ("home", pa.int64()), ("lo", pa.binary()), ("hi", pa.binary()),
    ("many", pa.binary()), ("roots", pa.binary()), ("refs", pa.binary()), ("centres", pa.binary()),
    ("sizes", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary())])
_HUB_SENT_SQL = ("g long, home long, lo binary, hi binary, many binary, roots binary, refs binary, "
                 "centres binary, sizes binary, counts binary, tokens binary")
_HUBS = pa.schema([
    ("home", pa.int64()), ("bucket", pa.int64()), ("lo", pa.binary()), ("hi", pa.binary()),
    ("many", pa.binary()), ("heads", pa.binary()), ("refs", pa.binary()), ("sizes", pa.binary()),
    ("counts", pa.binary()), ("tokens", pa.binary())])
_HUBS_SQL = ("home long, bucket long, lo binary, hi binary, many binary, heads binary, refs binary, "
             "sizes binary, counts binary, tokens binary")
_NEAR = pa.schema([("a", pa.int64()), ("n_a", pa.int64()), ("b", pa.int64()),
                   ("shared", pa.int64())])


def _heads(
    token: np.ndarray, root: np.ndarray, ref: np.ndarray, centre: np.ndarray, most: int
) -> tuple[np.ndarray, ...]:
    """Of each token's entries the most central one of each component, so many at most."""
    order = np.lexsort((ref, -centre, root, token))
    token, root, ref, centre = token[order], root[order], ref[order], centre[order]
    first = np.ones(len(token), bool)
    first[1:] = (token[1:] != token[:-1]) | (root[1:] != root[:-1])
    token, root, ref, centre = token[first], root[first], ref[first], centre[first]
    order = np.lexsort((ref, -centre, token))
    starts, many = packed.runs(token[order])
    rank = np.arange(len(token)) - np.repeat(starts, many)
    order = order[rank < most]
    return token[order], root[order], ref[order], centre[order]


def _send_hubs(bits: int, short: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinal = 0
        for batch in batches:
            refs, roots, sizes, centres = (batch.column(i).to_numpy() for i in range(4))
            bodies = batch.column(4)
            for a, b in packed.slices(pc.binary_length(bodies).to_pylist(), HOME_BYTES, HOME_ROWS):
                home = packed.home_number(ordinal)
                ordinal += 1
                sets = [packed.uncut(x, _width(bits)) for x in bodies[a:b].to_pylist()]
                counts = np.array([len(s) for s in sets], np.int32)
                every = np.concatenate(sets)
                token, root, ref, centre = _heads(
                    every, np.repeat(roots[a:b], counts), np.repeat(refs[a:b], counts),
                    np.repeat(centres[a:b], counts), short)
                starts, many = packed.runs(token)
                unique = token[starts]
                rows = [{"g": -1 - home, "home": home, "refs": refs[a:b].tobytes(),
                         "sizes": sizes[a:b].tobytes(), "counts": counts.tobytes(),
                         "tokens": packed.cut(every, _width(bits))}]
                cuts = np.searchsorted(unique, np.arange(
                    (1 << bits) + 1, dtype=np.uint64) << np.uint64(LOW_BITS)).tolist()
                places = np.concatenate([starts, [len(token)]])
                for bucket in range(1 << bits):
                    x, y = cuts[bucket], cuts[bucket + 1]
                    if y > x:
                        lo, hi = _low(unique[x:y])
                        c, d = places[x], places[y]
                        rows.append({
                            "g": bucket, "home": home, "lo": lo, "hi": hi,
                            "many": many[x:y].astype(np.uint8).tobytes(),
                            "roots": root[c:d].tobytes(), "refs": ref[c:d].tobytes(),
                            "centres": centre[c:d].astype(np.float32).tobytes()})
                yield from _table(rows, _HUB_SENT).to_batches()

    return send


def _hubs(short: int):
    return lambda key, table: _hubs_of_bucket(key, table, short)


def _hubs_of_bucket(key: tuple, table: pa.Table, short: int) -> pa.Table:
    """The heads of a bucket's tokens that several components hold, for each home that asked."""
    g = key[0].as_py()
    if g < 0:
        out = table.add_column(1, "bucket", pa.nulls(len(table), pa.int64()))
        out = out.append_column("heads", pa.nulls(len(table), pa.binary()))
        return out.select(_HUBS.names).cast(_HUBS)
    homes = table.column("home").to_pylist()
    n = range(len(homes))
    tokens = [_tokens(_binary(table, "lo", i), _binary(table, "hi", i), 0) for i in n]
    many = [np.frombuffer(_binary(table, "many", i), np.uint8) for i in n]

    def entries(name: str, kind: type) -> np.ndarray:
        return np.concatenate([np.frombuffer(_binary(table, name, i), kind) for i in n])

    token, root, ref, _ = _heads(
        np.concatenate([np.repeat(t, m) for t, m in zip(tokens, many, strict=True)]),
        entries("roots", np.int64), entries("refs", np.int64), entries("centres", np.float32),
        short)
    starts, lengths = packed.runs(token)
    names = token[starts]
    rows = []
    for home, asked in zip(homes, tokens, strict=True):
        place = np.searchsorted(names, asked)
        keep = lengths[place] > 1
        place = place[keep]
        if not len(place):
            continue
        size = lengths[place]
        index = np.repeat(starts[place] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        lo, hi = _low(asked[keep])
        rows.append({"home": home, "bucket": g, "lo": lo, "hi": hi,
                     "many": size.astype(np.uint8).tobytes(), "heads": ref[index].tobytes()})
    return _table(rows, _HUBS)


def _count_hubs(bits: int):
    return lambda table: _count_heads(table, _width(bits))


def _count_heads(table: pa.Table, width: int) -> pa.Table:
    """Pairs of a class and a head that meet in as many lists as the class needs."""
    names, many, heads = [np.empty(0, np.uint64)], [np.empty(0, np.uint8)], [np.empty(0, np.int64)]
    for i, bucket in enumerate(table.column("bucket").to_pylist()):
        if bucket is None:
            refs = np.frombuffer(_binary(table, "refs", i), np.int64).tolist()
            sizes = np.frombuffer(_binary(table, "sizes", i), np.int64)
            counts = np.frombuffer(_binary(table, "counts", i), np.int32)
            every = packed.uncut(_binary(table, "tokens", i), width)
        else:
            names.append(_tokens(_binary(table, "lo", i), _binary(table, "hi", i), bucket))
            many.append(np.frombuffer(_binary(table, "many", i), np.uint8))
            heads.append(np.frombuffer(_binary(table, "heads", i), np.int64))
    name, held, head = np.concatenate(names), np.concatenate(many), np.concatenate(heads)
    held = held.astype(np.int64)
    starts = np.cumsum(held) - held
    order = np.argsort(name, kind="stable")
    name, held, starts = name[order], held[order], starts[order]
    rows, end = [], 0
    for ref, n, count in zip(refs, sizes.tolist(), counts.tolist(), strict=True):
        own = every[end:end + count]
        end += count
        place = np.searchsorted(name, own)
        place = place[place < len(name)]
        own = own[:len(place)]
        place = place[name[place] == own]
        size = held[place]
        index = np.repeat(starts[place] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        partner, seen = np.unique(head[index], return_counts=True)
        close = (seen >= _needed(n)) & (partner != ref)
        rows += [{"a": ref, "n_a": n, "b": b, "shared": k} for b, k in
                 zip(partner[close].tolist(), seen[close].tolist(), strict=True)]
    return _table(rows, _NEAR)


def _overlap(width: int):
    @F.arrow_udf(T.LongType())
    def overlap(left: pa.Array, right: pa.Array) -> pa.Array:
        """Size of the intersection of two sorted sets: the smaller is searched in the larger."""
        out = []
        for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True):
            x, y = packed.uncut(a, width), packed.uncut(b, width)
            if len(x) > len(y):
                x, y = y, x
            place = np.minimum(np.searchsorted(y, x), len(y) - 1)
            out.append(int((y[place] == x).sum()))
        return pa.array(out, pa.int64())

    return overlap


def _linked(shared: str, n: str, other: str):
    """100 * intersection >= 75 * union."""
    return 100 * F.col(shared) >= 75 * (F.col(n) + F.col(other) - F.col(shared))


def _classes(active: DataFrame, bits: int, short: int) -> DataFrame:
    """One row per distinct set: cid, n, tokens, sorted by cid within a partition."""
    return active.where("tokens IS NOT NULL").groupBy("cid").agg(
        F.min("n").alias("n"), F.first("tokens").alias("tokens"),
    ).select("cid", "n", "tokens").mapInArrow(_send_classes(bits, short), _CLASS_SENT_SQL)


def _links(active: DataFrame, bits: int, short: int) -> tuple[DataFrame, DataFrame]:
    """Classes (ref, cid) and links between them that connect all linked ones."""
    merged = cut_lineage(
        _classes(active, bits, short)
        .groupBy("g").applyInArrow(_lists(short), _LISTS_SQL)
        .groupBy("home").applyInArrow(_merge(bits, short), _CLASSES_SQL))
    sizes = merged.select(F.col("ref").alias("b"), F.col("n").alias("n_b"))
    proven = cut_lineage(
        merged.select(F.col("ref").alias("a"), F.col("n").alias("n_a"), F.inline("near"))
        .withColumnRenamed("ref", "b").join(sizes, "b")
        .where(_linked("shared", "n_a", "n_b")).select("a", "b"))
    opened = merged.where("open")
    rounds = 0
    while True:
        roots = components(proven)
        rooted = opened.join(roots, F.col("ref") == F.col("node"), "left").select(
            "ref", "n", "s", "centre", F.coalesce("root", "ref").alias("root"), "rare", "tokens")
        # ``after``: shared tokens of the class from this one on, in the order of rarity.
        rare = rooted.select("ref", "n", "s", "root", F.posexplode("rare").alias("at", "token")).select(
            "ref", "n", "root", "token", (F.col("s") - F.col("at")).alias("after"))
        # Lists of the rarest tokens that still hold several components.
        mixed = rare.groupBy("token").agg(
            F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        held = cut_lineage(rare.join(mixed.select("token"), "token"))
        if rounds == HUB_ROUNDS:
            break
        rounds += 1
        asking = held.select("ref").distinct()
        near = (
            rooted.join(asking, "ref").select("ref", "root", "n", "centre", "tokens")
            .mapInArrow(_send_hubs(bits, short), _HUB_SENT_SQL)
            .groupBy("g").applyInArrow(_hubs(short), _HUBS_SQL)
            .groupBy("home").applyInArrow(_count_hubs(bits), "a long, n_a long, b long, shared long"))
        found = near.join(sizes, "b").where(_linked("shared", "n_a", "n_b")).select("a", "b")
        proven = cut_lineage(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(
            found).where("a <> b").distinct())
    # Of the tokens two linked classes share, the first in the order has the whole overlap, at least
    # 3/7 of both sizes, from it on in both.
    right = held.select("token", *[F.col(c).alias(f"{c}_b") for c in ("ref", "n", "root", "after")])
    met = cut_lineage(
        held.join(right, "token")
        .where("root < root_b AND 7 * after >= 3 * (n + n_b) AND 7 * after_b >= 3 * (n + n_b)")
        .select(F.col("ref").alias("a"), "n", F.col("ref_b").alias("b"), "n_b").distinct())
    sets = opened.select("ref", "tokens")
    probed = (
        met.join(sets.select(F.col("ref").alias("a"), F.col("tokens").alias("set_a")), "a")
        .join(sets.select(F.col("ref").alias("b"), F.col("tokens").alias("set_b")), "b")
        .withColumn("shared", _overlap(_width(bits))("set_a", "set_b"))
        .where(_linked("shared", "n", "n_b")).select("a", "b"))
    return merged.select("ref", "cid"), proven.union(probed)


def _grouped(docs: DataFrame, key: str, text: str, width: int, short: int) -> DataFrame:
    """doc_id, mark (hash of id and text), n, active and root of each row of ``docs``."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = max(8, int(size // BUCKET_BYTES).bit_length())
    rows = cut_lineage(
        docs.select(F.col(key).cast("long"), F.col(text), F.xxhash64(key, text))
        .mapInArrow(_send_documents(bits, width), _SENT_SQL)
        .groupBy("g").applyInArrow(_shared_in_bucket, _ANSWER_SQL)
        .groupBy("home").applyInArrow(_prune(bits), _DOCS_SQL))
    classes, links = _links(rows.where("active"), bits, short)
    rooted = classes.join(components(links), F.col("ref") == F.col("node"), "left").select(
        F.col("cid").alias("set"), F.coalesce("root", "ref").alias("root"))
    return rows.drop("tokens").join(
        rooted, (F.col("cid") == F.col("set")) & F.col("active"), "left").drop("set")


def ngram_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, short: int = SHORT
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable)."""
    rows = cut_lineage(_grouped(docs, key, text, width, short))
    smallest = rows.where("root IS NOT NULL").groupBy(F.col("root").alias("group")).agg(
        F.min("doc_id").alias("component"))
    return rows.join(smallest, F.col("root") == F.col("group"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"))


def one_per_group(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, short: int = SHORT
) -> DataFrame:
    """``docs`` with one document of each group of linked ones: the one of the smallest id.

    Rows equal in id and text are one document.
    """
    rows = cut_lineage(_grouped(docs, key, text, width, short))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    first = rows.where("root IS NOT NULL").groupBy(F.col("root").alias("group")).agg(
        F.min(order)["mark"].alias("first"))
    dropped = rows.join(first, F.col("root") == F.col("group")).where("mark <> first").select(
        "mark").distinct()
    repeated = rows.groupBy("mark").count().where("count > 1").limit(1).count() > 0
    marked = boxed(docs, key, text).select("_row", F.xxhash64(key, text).alias("row_mark"))
    kept = marked.join(dropped, F.col("row_mark") == F.col("mark"), "left_anti")
    if repeated:
        kept = kept.dropDuplicates(["row_mark"])
    return unboxed(kept)
