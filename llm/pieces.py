"""SentencePiece encoding and decoding by batched Viterbi in numpy.

Texts are cut into words where no piece can cross: before a run of spaces, and around white space that is in no longer
piece. The distinct words of a block that were not met before are encoded together. Hashes of all their substrings, a length
at a time, probe the sorted hashes of the pieces; then words advance together: at each step all pieces that end at the same
place of their words are taken at once, and a maximum gives each word's best score there and its backpointer. Words of equal
length end together. A word of more than LONG characters is swept alone, over the same pieces found, in time linear in it.

* Unigram models: the score of a path is the sum of its pieces' scores; an unknown character costs 10 more than the worst
  piece. Equal scores go to the longer last piece.
* BPE models: the merges of a word have exactly one result, and a path is that result if each piece encodes to itself and
  each neighbouring pair of pieces encodes to that pair. A pair that does not scores minus infinity, so that the best path
  is the model's own encoding. Pairs are tested for all words at once by undoing the later merge of the two sides until
  both are characters: the pair is broken by a merge across its border that comes before the one undone.
* BPE models whose pieces of spaces share one score under all others: such merges come last and the leftmost first, so a
  run of spaces is settled by itself, by its length alone, once the word behind it has taken the space that it needs.

Characters without a piece become their UTF-8 bytes where the model has byte pieces, else the unknown id.
Defined results: null and empty texts give no ids; a text that holds U+2581 decodes with a space in its place.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from llm import blocks as B
from llm.word_table import WordTable

SPACE = "▁"
#: Pairs of pieces whose answers a worker keeps.
PAIR_SLOTS = 1 << 21
#: Words of more characters are swept alone; characters that advance together; pairs that the sweep remembers.
LONG, CHARACTERS, REMEMBERED = 64, 1 << 17, 1 << 16
#: Bits of the sieve that most substrings end in, before they are sought among the keys.
SIEVE_BITS = 17
_PAIRS: dict[str, np.ndarray] = {}
_SWEEPS: dict[str, tuple] = {}
_TABLES: dict[str, WordTable] = {}
B.KEPT["pieces"] = [_PAIRS, _SWEEPS, _TABLES]


class Model(NamedTuple):
    name: str
    unigram: bool
    keys: list[np.ndarray]  # by length: ascending hashes of the pieces that paths are made of
    ids: list[np.ndarray]  # their ids
    sieves: list[np.ndarray]  # whether some key has these leading bits
    all_keys: np.ndarray  # those of all pieces that merges make
    all_ids: np.ndarray
    hashes: np.ndarray  # by id, as the rest
    length: np.ndarray
    score: np.ndarray
    rank: np.ndarray  # BPE: order of merges from 1; 0 for characters
    left: np.ndarray  # BPE: the two pieces of a piece's last merge
    right: np.ndarray
    whole: np.ndarray  # BPE: whether the piece encodes to itself
    scores: dict[str, tuple[float, int]]  # by piece
    spaces_last: bool  # BPE: pieces of several spaces share one score under all others
    byte_ids: np.ndarray  # of each byte, or of the unknown piece
    content: np.ndarray  # bytes of all pieces, decoded, end to end
    offsets: np.ndarray
    separators: str  # white space that is in no longer piece


def _character_codes(text: str) -> np.ndarray:
    return B.mix(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))


def _hash(text: str) -> int:
    """Sum of the characters' codes times BASE to their place, so that hashes of parts add up."""
    return sum(c * pow(int(B.BASE), k, 1 << 64) for k, c in enumerate(_character_codes(text).tolist())) % (1 << 64)


def merged(word: str, scores: dict[str, tuple[float, int]]) -> tuple[list[str], tuple[str, str] | None]:
    """BPE of one word: pieces, and the sides of the last merge. The best-scored pair goes first, the leftmost of equals."""
    parts, last = list(word), None
    while len(parts) > 1:
        best = max(((scores[s][0], -k) for k in range(len(parts) - 1) if (s := parts[k] + parts[k + 1]) in scores), default=None)
        if best is None:
            break
        k = -best[1]
        last = parts[k], parts[k + 1]
        parts[k : k + 2] = ["".join(last)]
    return parts, last


def load(path: str) -> Model:
    """A model file on the driver. Normalisation must be the identity with a leading space, as in models with byte pieces."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as format_of

    with open(path, "rb") as file:
        proto = format_of.ModelProto.FromString(file.read())
    kinds = format_of.ModelProto.SentencePiece
    rules, unigram = proto.normalizer_spec, proto.trainer_spec.model_type == format_of.TrainerSpec.UNIGRAM
    if rules.name != "identity" or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not (unigram or proto.trainer_spec.model_type == format_of.TrainerSpec.BPE):
        raise ValueError("only BPE and unigram models with identity normalisation and a leading space can be read")
    if any(p.type == kinds.USER_DEFINED for p in proto.pieces):
        raise ValueError("models with user-defined pieces cannot be read")
    n = len(proto.pieces)
    scores = {p.piece: (p.score, i) for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
    if any(SPACE in p.lstrip(SPACE) for p in scores):
        raise ValueError("a piece goes on behind a space")
    pieces = [p.piece for p in proto.pieces]
    hashes = np.array([_hash(p) for p in pieces], np.uint64)
    rank, left, right, whole = np.zeros(n, np.int64), np.arange(n), np.arange(n), np.zeros(n, bool)
    spaces_last = False
    if not unigram:
        order = sorted((p for p in scores if len(p) > 1), key=lambda p: (-scores[p][0], scores[p][1]))
        rank[[scores[p][1] for p in order]] = np.arange(1, len(order) + 1)
        for p, (_, i) in scores.items():
            parts, last = merged(p, scores)
            whole[i] = len(parts) == 1
            if whole[i] and last:
                left[i], right[i] = scores[last[0]][1], scores[last[1]][1]
        spaces = [scores[p][0] for p in order if not p.strip(SPACE)]
        plain = [scores[p][0] for p in order if p.strip(SPACE)]
        spaces_last = len(set(spaces)) < len(spaces)
        if len(set(plain)) < len(plain) or set(spaces) & set(plain) or spaces_last and (len(set(spaces)) > 1 or plain and max(spaces) > min(plain) or any(p.strip(SPACE) and p.startswith(SPACE * 2) for p in scores)):
            raise ValueError("pieces share a score")
    every = np.array([i for _, i in scores.values()])
    every = every[np.argsort(hashes[every])]
    used = [i for p, (_, i) in scores.items() if unigram or whole[i] and (len(p) == 1 or p.strip(SPACE) or not spaces_last)]
    sizes = np.array([len(p) for p in pieces])
    used = np.array(used)[np.argsort(hashes[used])]
    by_length = [used[sizes[used] == k] for k in range(sizes[used].max() + 1)]
    byte_ids = np.full(256, next((i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN), 0))
    content = []
    for i, p in enumerate(proto.pieces):
        if p.type == kinds.BYTE:
            byte_ids[int(p.piece[3:5], 16)] = i
            content.append(bytes([int(p.piece[3:5], 16)]))
        else:
            content.append(p.piece.replace(SPACE, " ").encode() if p.type == kinds.NORMAL else " ⁇ ".encode() if p.type == kinds.UNKNOWN else b"")
    longer = {c for p in scores if len(p) > 1 for c in p}
    sieves = []
    for u in by_length:
        sieves.append(np.zeros(1 << SIEVE_BITS, bool))
        sieves[-1][_sieve_place(hashes[u])] = True
    return Model(f"{path}/{n}/{unigram}/{sentencepiece.__version__}", unigram, [hashes[u] for u in by_length], by_length, sieves, hashes[every], every, hashes, sizes, np.array([p.score for p in proto.pieces], np.float64), rank, left, right, whole, scores, spaces_last, byte_ids, np.frombuffer(b"".join(content), np.uint8), np.concatenate([[0], np.cumsum([len(c) for c in content])]), "".join(c for c in "\n\t\r\x0b\x0c" if c not in longer))


def _sieve_place(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)


def _joined_rank(model: Model, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rank of the merge of a and b, or the largest integer."""
    n = model.length[b]
    h = model.hashes[a] + model.hashes[b] * B.powers(64)[0][model.length[a]]
    at = np.minimum(np.searchsorted(model.all_keys, h), len(model.all_keys) - 1)
    found = model.all_ids[at]
    return np.where((model.all_keys[at] == h) & (model.length[found] == n + model.length[a]), model.rank[found], np.iinfo(np.int64).max)


def _undone(model: Model, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging the text of two pieces yields just these two, for all pairs at once."""
    good = np.ones(len(a), bool)
    rows, limit = np.arange(len(a)), np.full(len(a), np.iinfo(np.int64).max)
    while len(rows):
        broken = _joined_rank(model, a, b) < limit
        good[rows[broken]] = False
        undo_left = model.rank[a] > model.rank[b]
        on = ~broken & (undo_left | (model.rank[b] > 0))
        limit = np.where(undo_left, model.rank[a], model.rank[b] + 1)[on]  # of equal merges the left one comes first
        a, b, rows = np.where(undo_left, model.right[a], a)[on], np.where(undo_left, b, model.left[b])[on], rows[on]
    return good


def _stable_pairs(model: Model, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """_undone(), with the answers of this worker's last pairs in a table of PAIR_SLOTS."""
    if model.name not in _PAIRS:
        _PAIRS[model.name] = np.zeros(PAIR_SLOTS, np.int64)
    known = _PAIRS[model.name]  # pair + 1, negative if it is not stable
    pair = a.astype(np.int64) * len(model.length) + b + 1
    slot = (B.mix(pair.view(np.uint64)) % np.uint64(PAIR_SLOTS)).astype(np.int64)
    answer = known[slot]
    new = np.flatnonzero(np.abs(answer) != pair)
    if len(new):
        found = np.where(_undone(model, a[new], b[new]), pair[new], -pair[new])
        known[slot[new]] = found
        answer[new] = found
    return answer > 0


def _pieces_found(model: Model, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, id) of all pieces in characters of words, ends being where each character's word does; -1 for a
    character without a piece. Shorter pieces come first.
    """
    values = B.mix(codes.astype(np.uint64) + np.uint64(1))
    powers, inverses = B.powers(len(codes) + 1)
    prefix = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(values * powers[:-1], out=prefix[1:])
    found = []
    at = np.arange(len(codes))
    for length in range(1, len(model.keys)):
        at = at[at + length <= ends[at]]
        keys = model.keys[length]
        if not len(at):
            break
        h = values if length == 1 else (prefix[at + length] - prefix[at]) * inverses[at]
        if length == 1:
            place = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            found.append((at, np.where(keys[place] == h, model.ids[1][place], -1) if len(keys) else np.full(len(h), -1)))
        elif len(keys):
            some = np.flatnonzero(model.sieves[length][_sieve_place(h)])
            place = np.minimum(np.searchsorted(keys, h[some]), len(keys) - 1)
            hit = keys[place] == h[some]
            found.append((at[some[hit]], model.ids[length][place[hit]]))
        else:
            found.append((at[:0], at[:0]))
    return np.concatenate([s for s, _ in found]), np.repeat(np.arange(1, len(found) + 1), [len(s) for s, _ in found]), np.concatenate([i for _, i in found])


def _unknown_score(model: Model) -> float:
    return min(float(model.score[i].min()) for i in model.ids if len(i)) - 10


def viterbi(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words, of one character at least, end to end, and how many each has; characters without a piece give -1 - their code point."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    start, length, piece = _pieces_found(model, codes, np.repeat(ends, sizes))
    # places between characters are numbered so that a word's first and last are its own
    word = np.repeat(np.arange(len(words)), sizes)
    local = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    step = local[start] + length
    order = np.lexsort((-length, start + length, step)) if model.unigram else np.argsort(step, kind="stable")
    begin, length, piece = (start + word[start])[order], length[order], piece[order]
    bounds = np.searchsorted(step[order], np.arange(1, int(sizes.max()) + 2))
    best, last, back = np.full(len(codes) + len(words), -np.inf), np.full(len(codes) + len(words), -1), np.zeros(len(codes) + len(words), np.int8)
    best[ends - sizes + np.arange(len(words))] = 0
    unknown = _unknown_score(model) if model.unigram else 0.0
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        b, n, p = begin[low:high], length[low:high], piece[low:high]
        if model.unigram:
            score = best[b] + np.where(p >= 0, model.score[p], unknown)
            e = b + n  # those of one place lie together, longer pieces first: they keep equal scores
            head = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
            top = np.repeat(np.maximum.reduceat(score, head), np.diff(np.append(head, len(e))))
            wins = np.flatnonzero(score == top)
            wins = wins[np.unique(e[wins], return_index=True)[1]]
        else:
            before = last[b]
            check = np.flatnonzero((before >= 0) & (p >= 0))
            stable = np.ones(len(p), bool)
            stable[check] = _stable_pairs(model, before[check], p[check])
            wins = np.flatnonzero(stable & (p >= 0))
            score = np.zeros(len(p))
            best[b[wins] + n[wins]] = 0
            alone = np.flatnonzero(p < 0)  # of a character without a piece, where no longer piece ends
            wins = np.concatenate([wins, alone[best[b[alone] + 1] == -np.inf]])
        at = b[wins] + n[wins]
        best[at], last[at], back[at] = score[wins], p[wins], n[wins]
    place, rows, steps = ends + np.arange(len(words)), np.arange(len(words)), []
    character = np.concatenate([codes.astype(np.int64), np.zeros(1, np.int64)])
    while len(rows):
        ids = last[place]
        steps.append((rows, np.where(ids >= 0, ids, -1 - character[np.maximum(place - rows - 1, 0)])))
        place = place - back[place]
        on = place > (ends - sizes)[rows] + rows
        place, rows = place[on], rows[on]
    rows, ids = (np.concatenate(c) for c in zip(*steps, strict=True))
    return ids[np.lexsort((-np.repeat(np.arange(len(steps)), [len(r) for r, _ in steps]), rows))], np.bincount(rows, minlength=len(words))


def _sweep_tables(model: Model) -> tuple:
    """The model's tables as plain lists, with the pairs remembered, for one word at a time."""
    if model.name not in _SWEEPS:
        names = [""] * len(model.length)
        for p, (_, i) in model.scores.items():
            names[i] = p
        ranks = {p: int(model.rank[i]) for p, (_, i) in model.scores.items()}
        _SWEEPS[model.name] = names, ranks, model.rank.tolist(), model.left.tolist(), model.right.tolist(), {}
    return _SWEEPS[model.name]


def swept(model: Model, word: str) -> np.ndarray:
    """viterbi() of one long word: a single pass over the pieces found, CHARACTERS at a time."""
    names, ranks, rank, left, right, known = _sweep_tables(model)
    longest, size, n_ids, unigram = len(model.keys) - 1, len(word), len(model.length), model.unigram
    last, back, best = [-1] * (size + 1), [0] * (size + 1), [0.0] * (size + 1)
    unknown, scores = _unknown_score(model) if unigram else 0.0, model.score.tolist()

    def stable(a: int, b: int) -> bool:
        limit = 1 << 62
        while True:
            if ranks.get(names[a] + names[b], limit) < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], right[a]
            elif rank[b]:
                limit, b = rank[b] + 1, left[b]
            else:
                return True

    for low in range(0, size, CHARACTERS):
        head = max(0, low - longest)
        part = word[head : low + CHARACTERS]
        start, length, piece = _pieces_found(model, np.frombuffer(part.encode("utf-32-le"), np.uint32), np.full(len(part), len(part)))
        end = start + length + head
        order = np.lexsort((piece < 0, -length, end))
        order = order[end[order] > low]
        done = low
        for e, n, p in zip(end[order].tolist(), length[order].tolist(), piece[order].tolist(), strict=True):
            if unigram:
                score = best[e - n] + (scores[p] if p >= 0 else unknown)
                if e == done and score <= best[e]:
                    continue
                best[e] = score
            elif e == done:
                continue  # BPE has one path to each place
            elif p >= 0 and (before := last[e - n]) >= 0:
                pair = before * n_ids + p
                good = known.get(pair)
                if good is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    good = known[pair] = stable(before, p)
                if not good:
                    continue
            done, last[e], back[e] = e, p, n
    out, at = [], size
    while at:
        out.append(last[at] if last[at] >= 0 else -1 - ord(word[at - 1]))
        at -= back[at]
    return np.array(out[::-1], np.int64)


def _spelled(model: Model, ids: np.ndarray) -> np.ndarray:
    """ids with unknown characters spelled in bytes, or as one unknown piece for a run of them."""
    if not len(ids) or ids.min() >= 0:
        return ids.astype(np.int32)
    out: list[int] = []
    run = False
    for i in ids.tolist():
        if i >= 0:
            out.append(i)
        elif (spelled := model.byte_ids[list(chr(-1 - i).encode("utf-8", "replace"))].tolist())[0] != model.byte_ids[0] or len(set(model.byte_ids.tolist())) > 1:
            out += spelled
        elif not run:
            out.append(int(model.byte_ids[0]))
        run = i < 0
    return np.array(out, np.int32)


def spaces(model: Model, n: int) -> list[int]:
    """Ids of a run of n spaces whose pieces share one score: the leftmost pair that is a piece merges first."""
    held: list[int] = []  # no two neighbours of it are a piece together
    for _ in range(n):
        held.append(1)
        while len(held) > 1 and SPACE * (held[-2] + held[-1]) in model.scores:
            held[-2:] = [held[-2] + held[-1]]
    return [model.scores[SPACE * k][1] if SPACE * k in model.scores else -1 - ord(SPACE) for k in held]


def encode_words(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words (with SPACE for spaces), of one character at least, end to end, and how many each has."""
    runs = {k: len(w) - len(w.lstrip(SPACE)) for k, w in enumerate(words) if w.startswith(SPACE * 2)} if model.spaces_last else {}
    cut = [w[runs[k] - 1 :] if k in runs else w for k, w in enumerate(words)]
    length = np.fromiter(map(len, cut), np.int64, len(cut))
    order = np.argsort(length, kind="stable")
    order = order[: np.searchsorted(length[order], LONG, "right")]
    total = np.cumsum(length[order])
    flats, first, sizes, held, low = [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0, 0
    while low < len(order):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + CHARACTERS, "right")))
        flat, n = viterbi(model, [cut[k] for k in order[low:high].tolist()])
        flats.append(flat)
        first[order[low:high]], sizes[order[low:high]] = held + np.cumsum(n) - n, n
        held, low = held + len(flat), high
    flat = np.concatenate(flats) if flats else np.zeros(0, np.int64)
    # words that need more: long ones, those behind a run of spaces, those with unknown characters
    odd = {k: swept(model, cut[k]) for k in np.flatnonzero(length > LONG).tolist()}
    negative = np.flatnonzero(flat < 0)
    by_first = np.argsort(first[order], kind="stable")
    spelled = order[by_first][np.searchsorted(first[order][by_first], negative, "right") - 1].tolist() if len(negative) else []
    odd |= {k: flat[first[k] : first[k] + sizes[k]] for k in {*spelled, *runs} - odd.keys()}
    more = []
    for k, ids in odd.items():
        if k in runs:
            lone = int(ids[0] == model.scores[SPACE][1] if SPACE in model.scores else ids[0] == -1 - ord(SPACE))
            ids = np.array(spaces(model, runs[k] - 1 + lone) + ids[lone:].tolist(), np.int64)
        ids = _spelled(model, ids)
        more.append(ids)
        first[k], sizes[k], held = held, len(ids), held + len(ids)
    flat = np.concatenate([flat, *more]).astype(np.int32)
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)], sizes


def _cut(model: Model, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, B.Words]:
    """A block's bytes with a space before every text but empty ones, and its words.

    A word is a run of spaces with what follows it, or one separator; what follows a separator starts a word too.
    """
    some = np.diff(starts) > 0
    data = np.insert(data, starts[:-1][some], 0x20)
    starts = starts + np.concatenate([[0], np.cumsum(some)])
    alone = np.isin(np.arange(256), list(model.separators.encode()))[data]
    space = data == 0x20
    begins = alone.copy()
    begins[1:] |= space[1:] & ~space[:-1] | alone[:-1]
    begins[starts[:-1][some]] = True
    begin = np.flatnonzero(begins)
    return data, B.Words(begin, np.append(begin[1:], len(data)) if len(begin) else begin, np.searchsorted(begin, starts))


def encode(model: Model, block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a block end to end, and where each text's begin."""
    data, starts = block.data, block.starts
    if SPACE.encode() in data.tobytes():  # the model's own sign for a space counts as one
        data, starts = B.text_buffers(pa.array([t.replace(SPACE, " ") for t in B.texts_of(block)], pa.string()))
    if model.name not in _TABLES:
        _TABLES[model.name] = WordTable()
    data, words = _cut(model, data, starts)
    ids, sizes = _TABLES[model.name].ids(data, words, lambda new: encode_words(model, [w.replace(" ", SPACE) for w in new]))
    return ids, np.concatenate([[0], np.cumsum(B.sums_by_text(sizes, words.first))])


def decode(model: Model, ids: np.ndarray, first: np.ndarray) -> pa.Array:
    """Texts of ids; first: where each text's begin, with their number behind."""
    size = model.offsets[ids + 1] - model.offsets[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    raw = model.content[np.arange(ends[-1], dtype=np.int32) + np.repeat((model.offsets[ids] - ends[:-1]).astype(np.int32), size)].tobytes()
    bounds = zip(ends[first[:-1]].tolist(), ends[first[1:]].tolist(), strict=True)
    return pa.array([raw[a + raw.startswith(b" ", a, b) : b].decode("utf-8", "replace") for a, b in bounds], pa.string())


def shared_model(spark: SparkSession, path: str) -> Broadcast:
    return spark.sparkContext.broadcast(load(path))


def with_piece_ids(documents: DataFrame, path: str, text: str = "text", out: str = "piece_ids") -> DataFrame:
    """documents with a column of their texts' ids; a column of that name is replaced."""
    documents = documents.drop(out)
    model, at = shared_model(documents.sparkSession, path), documents.columns.index(text)
    schema = T.StructType([*documents.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def per_batch(batches):
        for batch in batches:
            for block in B.blocks(batch.column(at)):
                ids, first = encode(model.value, block)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(c.slice(block.first, block.rows) for c in batch.columns), lists], schema.names)

    return documents.mapInArrow(B.trimmed(per_batch, "pieces"), schema)


def with_texts(encoded: DataFrame, path: str, ids: str = "piece_ids", out: str = "text") -> DataFrame:
    """encoded with a column of the texts that its ids spell; null ids give an empty text. A column of that name is replaced."""
    encoded = encoded.drop(out)
    model, at = shared_model(encoded.sparkSession, path), encoded.columns.index(ids)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())])

    def per_batch(batches):
        for batch in batches:
            lists = [np.asarray(x or [], np.int64) for x in batch.column(at).to_pylist()]
            first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, decode(model.value, flat, first)], schema.names)

    return encoded.mapInArrow(per_batch, schema)


def round_trips(documents: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_ids, crc32 of the ids as little-endian 32-bit integers, and whether decoding them gives the text again."""
    import zlib

    model = shared_model(documents.sparkSession, path)

    def per_batch(batches):
        for batch in batches:
            for block in B.blocks(batch.column(1)):
                texts = B.texts_of(block)
                ids, first = encode(model.value, block)
                raw = ids.astype("<u4").tobytes()
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                same = [a.replace(SPACE, " ") == b for a, b in zip(texts, decode(model.value, ids, first).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), pa.array(np.diff(first)), pa.array(sums, pa.int64()), pa.array(same)], ["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return documents.select("doc_id", text).mapInArrow(per_batch, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
