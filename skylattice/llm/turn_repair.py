"""Repair of conversations (operator 11): cheapest edits by a cost DP, the least audit among them by prefix-doubling path ranking.

A conversation is its rows by turn (nulls first; rows of one turn by hashes of role and text).  Edits turn the initials of its roles into ``(s?(ua)+)?``:
Keep costs 0, Rerole to user or assistant 1, Delete 2, Insert of an empty user or assistant text 5; a truncated row that is not deleted
adds 5, a blank or repeated one must be deleted.  The audit is the string of the edits' initials, of equal costs the least in ASCII.

1. *Symbols.*  A row becomes its initial and faults; equal rows of one turn are one symbol with a number of copies.  A row is repeated if its role and text
   have an earlier turn, which an aggregate tells.  Texts stay behind until step 5.
2. *Pieces.*  Symbols are sorted by range and cut into pieces of at most ``PIECE``, so that a conversation of any length is spread over tasks.  A piece is
   summed up as a matrix: the least cost from each state (nothing yet, after s, u or a) to each other.  Folding the
   matrices from the last piece on gives the cost beyond each piece, a few numbers a piece.
3. *Ranking.*  In a piece, a node is a place and a state; its optimal arcs are the edits that the cost allows.  Arcs of one node bear different letters, so the least one is
   the first letter of its audit.  Nodes are then ranked by their audits of 2, 4, 8, ... letters: by the rank of the first half and the
   rank of the node that the pointer of that length leads to.  Entries of equal final rank share one path, which the doubled pointers read out for all its places at once.
4. *Entries.*  Each piece answers for every state it may be entered in; a second fold, from the first piece on, chooses.
5. *Lines.*  Edits meet the texts once, in one range sort; tasks write the repaired lines in order.  For a digest, conversations within one task are hashed there, and
   those at its edges go on as chunks of about a megabyte that are hashed as they stream by.

Null roles and texts count as one space.  Rows without a conversation id form one conversation of null id.  A conversation of which no row is left has zeros and
an empty audit.  An empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import list_array, stored

PIECE = 4096
CHUNK = 1 << 20
SPACES = " \t\n\x0b\x0c\r"
#: States: nothing yet, after s, after u, after a.  An inserted row is the next one that the pattern asks for.
START, S, U, A = range(4)
NEXT = np.array([U, U, A, U])
END_COST = np.array([0, 10, 5, 0], np.int64)  # by inserts after the last row
DELETE, REROLE, INSERT, CUT = 2, 1, 5, 5
FAR = 1 << 40
ROLES = {U: "user", A: "assistant"}
KEY = ("conv", "known", "turn", "x1", "x2")


# --- symbols ---------------------------------------------------------------------------------------------------------------------------------------


def _keyed(turns: DataFrame) -> DataFrame:
    """Rows under fixed names, with two hashes of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(F.struct(F.col("conv_id").isNotNull().alias("known"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("id")).alias("conv"), F.col("turn").cast("long").alias("at"), role.alias("role"), text.alias("text"))
    hashes = [F.xxhash64(F.lit(k), "role", "text").alias(f"x{k}") for k in (1, 2)]
    return rows.select("conv", F.col("at").isNotNull().alias("known"), F.coalesce("at", F.lit(0)).alias("turn"), *hashes, "role", "text")


def _symbols(rows: DataFrame) -> DataFrame:
    """One row for equal rows of a turn: its key, initial, faults and number of copies."""
    end = F.rtrim("text", F.lit(SPACES))
    initial = F.instr(F.lit("sua"), F.substring("role", 1, 1)) * (F.length("role") > 0).cast("int")  # 1 s, 2 u, 3 a, 0 another
    light = rows.select(*KEY, initial.cast("int").alias("initial"), (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"))
    one = light.groupBy(*KEY).agg(F.max("initial").alias("initial"), F.max("blank").alias("blank"), F.max("cut").alias("cut"), F.count("*").alias("copies"))
    firsts = light.groupBy("conv", "x1", "x2").agg(F.min(F.struct("known", "turn")).alias("at")).select("conv", "at.*", "x1", "x2", F.lit(True).alias("first"))
    return one.join(firsts, list(KEY), "left").withColumn("first", F.coalesce("first", F.lit(False)))


# --- costs -----------------------------------------------------------------------------------------------------------------------------------------


class Pieces:
    """Symbols of several pieces: ``first[i]:first[i + 1]`` are those of piece i.  Piece i has one node more than symbols, from ``base[i]`` on."""

    def __init__(self, first: np.ndarray, initial: np.ndarray, dead: np.ndarray, cut: np.ndarray, copies: np.ndarray):
        self.first, self.initial, self.dead, self.copies = first, initial, dead, copies
        self.counts = np.diff(first)
        self.base = first[:-1] + np.arange(len(first) - 1)
        self.penalty = np.where(cut, CUT, 0)
        self.more = DELETE * (copies - 1)  # copies beyond the first always go
        self.keep = {s: np.where(~dead & (initial == s), self.penalty, FAR) for s in (S, U, A)}
        self.rerole = np.where(dead, FAR, self.penalty + REROLE)

    def costs(self, beyond: np.ndarray) -> np.ndarray:
        """Least costs from each node and state, given those at the ends of the pieces (pieces, states, any number of columns)."""
        out = np.empty((len(self.initial) + len(self.base), 4, beyond.shape[2]), np.int64)
        out[self.base + self.counts] = beyond
        order = np.argsort(-self.counts, kind="stable")
        live = np.searchsorted(-self.counts[order], -np.arange(1, int(self.counts.max(initial=0)) + 1), "right")
        for j, n in enumerate(live.tolist(), 1):  # the j-th symbols from the ends
            some = order[:n]
            k = self.first[some + 1] - j
            node = self.base[some] + self.counts[some] - j
            after = out[node + 1]
            cost = after + DELETE
            user = np.minimum(self.keep[U][k], self.rerole[k])[:, None] + after[:, U]
            for s in (START, S, A):
                cost[:, s] = np.minimum(cost[:, s], user)
            cost[:, START] = np.minimum(cost[:, START], self.keep[S][k][:, None] + after[:, S])
            cost[:, U] = np.minimum(cost[:, U], np.minimum(self.keep[A][k], self.rerole[k])[:, None] + after[:, A])
            u, a = cost[:, U].copy(), cost[:, A].copy()
            cost[:, U], cost[:, A] = np.minimum(u, a + INSERT), np.minimum(a, u + INSERT)
            for s in (START, S):
                cost[:, s] = np.minimum(cost[:, s], cost[:, U] + INSERT)
            out[node] = cost + self.more[k][:, None, None]
        return out

    def arcs(self, beyond: np.ndarray, closing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letter (1 D, 2 I, 3 K, 4 R, 0 at an end) and target of the least optimal arc of every (node, state), numbered node * 4 + state."""
        cost = self.costs(beyond[:, :, None])[:, :, 0]
        nodes = np.arange(len(cost))
        ends = self.base + self.counts
        inner = np.ones(len(cost), bool)
        inner[ends] = False
        row = np.zeros(len(cost), np.int64)  # symbol of each inner node
        row[inner] = np.arange(len(self.initial))
        letter, target = np.zeros((len(cost), 4), np.int64), np.repeat(nodes * 4, 4).reshape(-1, 4) + np.arange(4)
        insert = np.ones(len(cost), bool)
        insert[ends] = closing
        for s in range(4):
            free = np.flatnonzero(inner)
            k, own = row[free], cost[free, s] - self.more[row[free]]
            options = [(4, self.rerole[k], int(NEXT[s])), *[(3, self.keep[to][k], to) for to in ((S, U) if s == START else (int(NEXT[s]),))]]
            for sign, price, to in options:  # a later and lesser letter takes over
                best = own == price + cost[free + 1, to]
                letter[free[best], s], target[free[best], s] = sign, (free[best] + 1) * 4 + to
            added = np.flatnonzero(insert & (cost[:, s] == INSERT + cost[:, NEXT[s]]))
            letter[added, s], target[added, s] = 2, added * 4 + NEXT[s]
            gone = free[own == DELETE + cost[free + 1, s]]
            letter[gone, s], target[gone, s] = 1, (gone + 1) * 4 + s
        return letter.ravel(), target.ravel()


def least_paths(letter: np.ndarray, target: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Paths from ``starts``: (number of the audit of each start, the letters of each audit in order of rank, the node at the end of each start's path)."""
    rank, pointers, length = letter, [target], (letter > 0).astype(np.int64)
    while (letter[pointers[-1][starts]] > 0).any():
        step = pointers[-1]
        _, rank = np.unique(rank * (int(rank.max()) + 1) + rank[step], return_inverse=True)  # nodes at an end keep rank 0: their pair is the least
        length = length + length[step]
        pointers.append(step[step])
    _, one, number = np.unique(rank[starts], return_index=True, return_inverse=True)
    size = length[starts[one]]
    first = np.concatenate([[0], np.cumsum(size)])
    node = np.repeat(starts[one], size)
    place, last = np.arange(len(node)) - np.repeat(first[:-1], size), starts.copy()
    for k, pointer in enumerate(pointers):
        jump = np.flatnonzero(place >> k & 1)
        node[jump] = pointer[node[jump]]
        jump = np.flatnonzero(length[starts] >> k & 1)
        last[jump] = pointer[last[jump]]
    return number, np.split(letter[node], first[1:-1]), last


# --- pieces ----------------------------------------------------------------------------------------------------------------------------------------

_CONV = pa.struct([("known", pa.bool_()), ("id", pa.int64())])
_CONV_SQL = "conv struct<known:boolean,id:long>"
_ROWS = [("known", pa.bool_()), ("turn", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("initial", pa.int8()), ("dead", pa.bool_()), ("cut", pa.bool_()), ("copies", pa.int64())]
_NUMBERS = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first_initial", "last_initial")
_AT_SQL = f"{_CONV_SQL}, known boolean, turn long, x1 long, x2 long"
_AT = pa.schema([("conv", _CONV), *_ROWS[:4]])
_KINDS = {pa.bool_(): "boolean", pa.int64(): "long", pa.int8(): "tinyint"}
_PIECE = pa.schema([*_AT, *((f"all_{n}", pa.list_(t)) for n, t in _ROWS), ("matrix", pa.list_(pa.int64())), *((n, pa.int64()) for n in _NUMBERS)])
_PIECE_SQL = ", ".join([_AT_SQL, *(f"all_{n} array<{_KINDS[t]}>" for n, t in _ROWS), "matrix array<long>", *(f"{n} long" for n in _NUMBERS)])


def _plain(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, f.type) for values, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)


def _pieces_of(batch: pa.RecordBatch) -> tuple[Pieces, np.ndarray]:
    first = np.concatenate([[0], np.cumsum(_plain(batch.column("all_initial").value_lengths()))]).astype(np.int64)
    flat = {n: _plain(batch.column(f"all_{n}").flatten()) for n in ("initial", "dead", "cut", "copies")}
    return Pieces(first, flat["initial"].astype(np.int64), flat["dead"].astype(bool), flat["cut"].astype(bool), flat["copies"].astype(np.int64)), first


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of sorted symbols, each with its matrix and counts.  A piece ends with its batch too."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = {n: _plain(batch.column(n)) for n in ("known", "turn", "initial", "blank", "cut", "first", "copies")}
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.any([ids[1:] != ids[:-1] for ids in map(_plain, batch.column("conv").flatten())], axis=0)
        begin = np.flatnonzero(new)
        place = np.arange(batch.num_rows) - np.repeat(begin, np.diff(np.append(begin, batch.num_rows)))
        begin = np.flatnonzero(place % PIECE == 0)
        first = np.append(begin, batch.num_rows)
        dead = col["blank"] | ~col["first"]
        copies, initial, known, turn = col["copies"].astype(np.int64), col["initial"].astype(np.int64), col["known"], col["turn"]
        matrix = Pieces(first, initial, dead, col["cut"], copies).costs(np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, FAR), (len(begin), 4, 4)))[begin + np.arange(len(begin))]
        inside = np.ones(batch.num_rows, bool)
        inside[begin] = False
        before = np.roll(initial, 1)
        legal = ((before == S) & (initial == U)) | ((before == U) & (initial == A)) | ((before == A) & (initial == U))
        fresh = known & (~inside | ~np.roll(known, 1) | (np.roll(turn, 1) != turn))
        each = lambda values: np.add.reduceat(values.astype(np.int64), begin)
        numbers = {
            "blank": each(np.where(col["blank"], copies, 0)),
            "duplicate": each(np.where(col["blank"], 0, copies - col["first"])),
            "truncated": each(~dead & col["cut"]),
            "illegal": each((inside & ~legal) + copies - 1),
            "turns": each(fresh),
            "low": np.minimum.reduceat(np.where(known, turn, np.iinfo(np.int64).max), begin),
            "high": np.maximum.reduceat(np.where(known, turn, np.iinfo(np.int64).min), begin),
            "first_initial": initial[begin],
            "last_initial": initial[first[1:] - 1],
        }
        at, sizes = pa.array(begin), np.diff(first)
        lists = [list_array(v, sizes, t) for (n, t), v in zip(_ROWS, [known, turn, _plain(batch.column("x1")), _plain(batch.column("x2")), initial.astype(np.int8), dead, col["cut"], copies], strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(n).take(at) for n in KEY), *lists, list_array(matrix.ravel(), np.full(len(begin), 16), pa.int64()), *(pa.array(numbers[n]) for n in _NUMBERS)], schema=_PIECE)


def _by_conversation(pieces: DataFrame, last_first: bool, *columns: str) -> DataFrame:
    """The named columns of pieces, those of a conversation together and in order."""
    order = [F.desc(c) if last_first else F.asc(c) for c in KEY]
    return pieces.select(*KEY, *columns).repartition("conv").sortWithinPartitions(*order)


_BOUND = pa.schema([*_AT, ("beyond", pa.list_(pa.int64())), ("opening", pa.bool_()), ("closing", pa.bool_()), *((n, pa.int64()) for n in ("cost", "gaps", "blank", "duplicate", "truncated", "illegal"))])
_BOUND_SQL = f"{_AT_SQL}, beyond array<long>, opening boolean, closing boolean, cost long, gaps long, blank long, duplicate long, truncated long, illegal long"


def _fold_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs beyond each piece, from the last on; the first piece of a conversation also bears its cost and counts."""
    held, beyond, sums = None, END_COST, {}

    def row(piece: dict, opening: bool) -> dict:
        whole = dict.fromkeys(("cost", "gaps", "blank", "duplicate", "truncated", "illegal"))
        if opening:
            gaps = sums["high"] - sums["low"] + 1 - sums["turns"] if sums["turns"] else 0
            whole = {n: sums[n] for n in whole if n in sums} | {"cost": int(sums["costs"][START]), "gaps": gaps}
        return {n: piece[n] for n in KEY} | {"beyond": piece["beyond"], "opening": opening, "closing": piece["closing"]} | whole

    for batch in batches:
        out = []
        for piece in batch.to_pylist():
            same = held is not None and held["conv"] == piece["conv"]
            if held is not None:
                out.append(row(held, not same))
            if not same:
                beyond, sums = END_COST, {}
            piece["beyond"], piece["closing"] = beyond.tolist(), not same
            if sums:
                pair = (piece["last_initial"], held["first_initial"])
                sums["illegal"] += pair not in ((S, U), (U, A), (A, U))
                sums["turns"] -= bool(held["known"] and piece["last_known"] and piece["last_turn"] == held["turn"])
            for n in ("blank", "duplicate", "truncated", "illegal", "turns"):
                sums[n] = sums.get(n, 0) + piece[n]
            sums["low"], sums["high"] = min(sums.get("low", piece["low"]), piece["low"]), max(sums.get("high", piece["high"]), piece["high"])
            beyond = sums["costs"] = (np.array(piece["matrix"]).reshape(4, 4) + beyond).min(1)
            held = piece
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_BOUND)
    if held is not None:
        yield pa.RecordBatch.from_pylist([row(held, True)], schema=_BOUND)


_ANSWER = pa.struct([("leave", pa.int8()), ("audit", pa.string())])
_KEPT = [*_ROWS[:5], _ROWS[-1]]  # what the lines need
_ANSWERS = pa.schema([*_AT, *((f"all_{n}", pa.list_(t)) for n, t in _KEPT), ("answers", pa.list_(_ANSWER))])
_ANSWERS_SQL = f"{_AT_SQL}, " + ", ".join(f"all_{n} array<{_KINDS[t]}>" for n, t in _KEPT) + ", answers array<struct<leave:tinyint,audit:string>>"


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece, and each state it may be entered in (the first piece in one only), the state it leaves and the audit.

    A letter of the audit is followed by the deletions of a row's copies."""
    for batch in batches:
        if not batch.num_rows:
            continue
        pieces, first = _pieces_of(batch)
        opening = _plain(batch.column("opening")).astype(bool)
        beyond = _plain(batch.column("beyond").flatten()).reshape(-1, 4)
        letter, target = pieces.arcs(beyond, _plain(batch.column("closing")).astype(bool))
        entries = np.where(opening, 1, 4)
        owner = np.repeat(np.arange(len(entries)), entries)
        state = np.arange(len(owner)) - np.repeat(np.cumsum(entries) - entries, entries)
        number, audits, last = least_paths(letter, target, pieces.base[owner] * 4 + state)
        signs = np.frombuffer(b" DIKR", np.uint8)
        plain = [signs[a].tobytes().decode() for a in audits]
        rows = []
        for k, n, leave in zip(owner.tolist(), number.tolist(), (last % 4).tolist(), strict=True):
            audit, copies = plain[n], pieces.copies[first[k] : first[k + 1]]
            if (copies > 1).any():
                more = np.zeros(len(audit), np.int64)
                more[audits[n] != 2] = copies - 1
                audit = "".join(c + "D" * int(m) for c, m in zip(audit, more, strict=True))
            rows.append({"leave": leave, "audit": audit})
        answers = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(entries)]).astype(np.int32)), pa.array(rows, _ANSWER))
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in KEY), *(batch.column(f"all_{n}") for n, _ in _KEPT), answers], schema=_ANSWERS)


def _fold_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state that each piece is entered in, from the first piece of a conversation on."""
    conv, state = None, START
    for batch in batches:
        entry = []
        for own, leaves in zip(batch.column("conv").to_pylist(), batch.column("leaves").to_pylist(), strict=True):
            if own != conv:
                conv, state = own, START
            entry.append(state)
            state = leaves[state]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in KEY), pa.array(entry, pa.int32())], names=[*KEY, "entry"])


def _joined_audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of each conversation from those of its pieces, which come in order."""
    conv, parts, schema = None, [], pa.schema([("conv", _CONV), ("audit", pa.string())])
    for batch in batches:
        done = []
        for own, audit in zip(batch.column("conv").to_pylist(), batch.column("audit").to_pylist(), strict=True):
            if own != conv and conv is not None:
                done.append((conv, "".join(parts)))
                parts = []
            conv = own
            parts.append(audit)
        yield _rows(done, schema)
    if conv is not None:
        yield _rows([(conv, "".join(parts))], schema)


# --- lines -----------------------------------------------------------------------------------------------------------------------------------------

_EDIT = pa.schema([*_AT, ("before", pa.list_(pa.string())), ("keep", pa.bool_()), ("as_role", pa.string()), ("after", pa.list_(pa.string()))])
_EDIT_SQL = f"{_AT_SQL}, before array<string>, keep boolean, as_role string, after array<string>"


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row that leaves lines: roles inserted before it, whether it stays and as which role (null: its own), roles inserted after it."""
    for batch in batches:
        out = []
        for piece in batch.to_pylist():
            state, audit, at, edits = piece["entry"], piece["audit"], 0, []
            for k, (initial, copies) in enumerate(zip(piece["all_initial"], piece["all_copies"], strict=True)):
                before, role, keep = [], None, False
                while audit[at] == "I":
                    state, at = int(NEXT[state]), at + 1
                    before.append(ROLES[state])
                if audit[at] != "D":
                    keep, state = True, S if audit[at] == "K" and initial == S else int(NEXT[state])
                    role = ROLES[state] if audit[at] == "R" else None
                at += copies
                if before or keep:
                    edits.append([k, before, keep, role, []])
            after = []
            while at < len(audit):
                state, at = int(NEXT[state]), at + 1
                after.append(ROLES[state])
            if after:
                if not edits or edits[-1][0] != len(piece["all_initial"]) - 1:
                    edits.append([len(piece["all_initial"]) - 1, [], False, None, []])
                edits[-1][4] = after
            keys = [piece[f"all_{n}"] for n in KEY[1:]]
            out += [(piece["conv"], *(column[k] for column in keys), *rest) for k, *rest in edits]
        yield _rows(out, _EDIT)


_LINE = pa.schema([*_AT, ("line", pa.int32()), ("role", pa.string()), ("text", pa.string())])
_LINE_SQL = f"{_AT_SQL}, line int, role string, text string"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of the repaired conversations, from edits that are each followed by the rows they are about."""
    edit = None
    for batch in batches:
        out = []
        columns = [batch.column(n).to_pylist() for n in (*KEY, "before", "keep", "as_role", "after", "role", "text")]
        for *key, before, keep, as_role, after, role, text in zip(*columns, strict=True):
            if before is not None:
                edit = (key, before, keep, as_role, after)
            elif edit is not None and edit[0] == key:  # of equal rows the first one
                _, before, keep, as_role, after = edit
                edit = None
                said = [*((r, "") for r in before), *([(as_role or role, text)] if keep else []), *((r, "") for r in after)]
                out += [(*key, k, r, t) for k, (r, t) in enumerate(said)]
        yield _rows(out, _LINE)


_CHUNK = pa.schema([*_AT, ("number", pa.int64()), ("sha256", pa.string()), ("chunk", pa.string())])
_CHUNK_SQL = f"{_AT_SQL}, number long, sha256 string, chunk string"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of short conversations that lie within this task; chunks of long ones and of the first and last one, which may go on elsewhere."""
    key, parts, size, number, first = None, [], 0, 0, True
    for batch in batches:
        done = []
        for *at, role, text in zip(*(batch.column(n).to_pylist() for n in (*KEY, "role", "text")), strict=True):
            if key is None or at[0] != key[0]:
                if key is not None:
                    whole = "\n".join(parts)
                    done.append((*key, number, None, whole) if first or number else (*key, 0, hashlib.sha256(whole.encode()).hexdigest(), None))
                    first = False
                key, parts, size, number = at, [], 0, 0
            if size >= CHUNK:
                done.append((*key, number, None, "\n".join(parts)))
                parts, size, number = [], 0, number + 1
            parts.append(f"{role}:{text}")
            size += len(parts[-1])
        yield _rows(done, _CHUNK)
    if key is not None:
        yield _rows([(*key, number, None, "\n".join(parts))], _CHUNK)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose chunks come in order."""
    conv, digest, schema = None, hashlib.sha256(), pa.schema([("conv", _CONV), ("sha256", pa.string())])
    for batch in batches:
        done = []
        for own, chunk in zip(batch.column("conv").to_pylist(), batch.column("chunk"), strict=True):
            if own != conv:
                if conv is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest = own, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(chunk.as_py().encode())
        yield _rows(done, schema)
    if conv is not None:
        yield _rows([(conv, digest.hexdigest())], schema)


# --- the operator ----------------------------------------------------------------------------------------------------------------------------------


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, lines) of ``turns`` (conv_id, turn, role, text and any others).

    Conversations that have rows: conv, cost, gaps, blank, duplicate, truncated, illegal and audit.  Lines of the repaired ones, in order within each
    task: conv, the key of the row that each belongs to, its number there, role and text.
    """
    rows = _keyed(turns)
    ordered = _symbols(rows).repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    pieces = stored(ordered.mapInArrow(_cut, _PIECE_SQL), "pieces")
    last = [F.element_at(f"all_{n}", -1).alias(f"last_{n}") for n in ("known", "turn")]
    bounds = stored(_by_conversation(pieces.select("*", *last), True, "matrix", "last_known", "last_turn", *_NUMBERS).mapInArrow(_fold_back, _BOUND_SQL), "bounds")
    beside = pieces.drop("matrix", *_NUMBERS).join(bounds.select(*KEY, "beyond", "opening", "closing"), list(KEY))
    answers = stored(beside.mapInArrow(_answer, _ANSWERS_SQL), "answers")
    entries = _by_conversation(answers, False, F.col("answers.leave").alias("leaves")).mapInArrow(_fold_on, f"{_AT_SQL}, entry int")
    chosen = answers.join(entries, list(KEY)).withColumn("audit", F.get("answers", F.col("entry"))["audit"]).drop("answers")
    audits = _by_conversation(chosen, False, "audit").mapInArrow(_joined_audits, f"{_CONV_SQL}, audit string")
    conversations = bounds.filter("opening").select("conv", "cost", "gaps", "blank", "duplicate", "truncated", "illegal").join(audits, "conv")
    edits = chosen.mapInArrow(_edits, _EDIT_SQL)
    told = edits.unionByName(rows, allowMissingColumns=True).repartitionByRange(*KEY).sortWithinPartitions(*KEY, F.col("before").isNull())
    return conversations, told.select(*KEY, "before", "keep", "as_role", "after", "role", "text").mapInArrow(_lines, _LINE_SQL)


def repair_report(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each conv_id of ``ids``: gaps, blank, duplicate, truncated, illegal, cost, audit and sha-256 of the repaired ``role:text`` lines."""
    conversations, lines = repair(turns)
    chunks = lines.mapInArrow(_chunks, _CHUNK_SQL)
    long = chunks.filter("sha256 IS NULL").repartition("conv").sortWithinPartitions(*KEY, "number").select("conv", "chunk").mapInArrow(_streamed, f"{_CONV_SQL}, sha256 string")
    digests = chunks.filter("sha256 IS NOT NULL").select("conv", "sha256").union(long)
    original = ids.select(F.struct(F.col("conv_id").isNotNull().alias("known"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("id")).alias("conv")).distinct()
    out = original.join(conversations.join(digests, "conv", "left"), "conv", "left")
    number = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    numbers = [number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.when(F.col("conv.known"), F.col("conv.id")).alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with faults by the checksum of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes its full
    stops, exclamation and question marks, 3 repeats it, 4 gives it the role user.  Nulls of role and text, and in the checksum, are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20).alias("fault")
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fault).filter("fault <> 0")
    text: Column = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")
