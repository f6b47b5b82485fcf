"""Byte-pair encoding as a streaming transducer, and decoding as an incremental byte-to-text machine.

Let e(x) be the merge list's encoding of x and last(n) the final token of e(x[:n]). Adjacent tokens s, t stand side
by side in an encoding exactly when e(st) = [s, t], and for every prefix exactly one token t that ends at n is so
compatible with last(n - |t|); so last(n) follows from the positions that the longest token reaches.

When a token is stable follows from the merge list alone (after Berglund and van der Merwe, "Formalizing BPE
Tokenization", 2023). Compare x[:n] with any text that goes on from there, rule by rule in the order of ranks. Left of a
frontier, at first n, both have the same tokens. A rule (u, v) moves it, by |u| and once only, if u ends there and v
begins there in one of the texts; the token that begins at the new frontier is then u or grows from u to the right. So
of two rules that move it one after another, the later has the earlier one's u at the left edge of its v. The heaviest
such chain of rules is how far back bytes not yet seen can reach: the lookahead. Tokens that end so far before the
last byte seen are emitted; what is held is the lookahead and eight
of the longest tokens, whatever the length of the text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

from pyspark.sql import DataFrame

#: The published split pattern of byte-level BPE vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces handed from splitter to encoder at a time, and entries of a memo's generation.
RUN, MEMO = 1 << 15, 300_000


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in for each byte: itself if printable in Latin-1, else the next free code point from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """So many bytes after the end of a token it is stable, in every text. Refuses lists that use a token before the last rule that makes it."""
    ways: dict[bytes, list[bytes]] = {}  # token -> left parts of the rules that make it
    weight: dict[bytes, int] = {}  # u -> the heaviest chain so far that ends with a rule (u, v)
    used: set[bytes] = set()
    for u, v in merges:
        if any(len(t) > 1 and t not in ways for t in (u, v)) or u + v in used:
            raise ValueError(f"merges out of order at {u!r}, {v!r}")
        used |= {u, v}
        edge, todo = set(), [v]
        while todo:
            if (t := todo.pop()) not in edge:
                edge.add(t)
                todo += ways.get(t, ())
        weight[u] = max(weight.get(u, 0), len(u) + max((weight.get(t, 0) for t in edge), default=0))
        ways.setdefault(u + v, []).append(u)
    return max(weight.values(), default=0)


class MergeList:
    """A vocabulary with ranked merges, its longest token, its lookahead, and which tokens may stand side by side."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ids = vocab
        self.bytes_of = {i: b for b, i in vocab.items()}
        self.rank = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(merges)}
        self.lookahead, self.longest = sufficient_lookahead(merges), max(map(len, vocab))
        made = [bytes([b]) for b in range(256) if bytes([b]) in vocab] + [a + b for a, b in merges]
        #: Tokens that the merges do build from their bytes; any other entry of the vocabulary never occurs.
        self.made = {t: vocab[t] for t in made if self.merged(t) == [vocab[t]]}
        self._beside: dict[int, bool] = {}
        # Tokens read backwards: (node << 8 | byte) -> node, and the token that a node completes.
        self.back: dict[int, int] = {}
        self.ends_at: list[int] = [-1]
        for token, i in self.made.items():
            node = 0
            for byte in reversed(token):
                key = node << 8 | byte
                if (node := self.back.get(key, 0)) == 0:
                    node = self.back[key] = len(self.ends_at)
                    self.ends_at.append(-1)
            self.ends_at[node] = i

    def merged(self, data: bytes) -> list[int]:
        """The definition: merge the lowest-ranked, leftmost pair until none is left. For pairs of tokens only."""
        parts = [self.ids[data[k : k + 1]] for k in range(len(data))]
        ranks, none = self.rank, (len(self.rank), -1)
        near = [ranks.get(p, none) for p in zip(parts, parts[1:])]
        while near:
            best = min(near)
            if best is none:
                break
            k = near.index(best)
            parts[k : k + 2] = [best[1]]
            del near[k]
            if k < len(near):
                near[k] = ranks.get((parts[k], parts[k + 1]), none)
            if k:
                near[k - 1] = ranks.get((parts[k - 1], parts[k]), none)
        return parts

    def beside(self, left: int, right: int) -> bool:
        if (known := self._beside.get(left << 32 | right)) is None:
            if len(self._beside) > 4 * MEMO:
                self._beside.clear()
            known = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self._beside[left << 32 | right] = known
        return known


class Encoder:
    """Feed bytes of one piece, get tokens as they become stable; finish() gives the rest."""

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.reset()

    def reset(self) -> None:
        self.window, self.last, self.before = b"", [], None  # last[k] ends after window[k]; before: the token emitted last

    def feed(self, data: bytes) -> list[int]:
        m, out = self.merges, []
        step, ends_at, known = m.back.get, m.ends_at, m._beside
        for at in range(0, len(data), 4 * m.longest):
            start = len(self.window)
            window = self.window = self.window + data[at : at + 4 * m.longest]
            last, before = self.last, self.before
            for n in range(start, len(window)):
                # Tokens that end with byte n, shortest first.
                node, k, ending = 0, n, []
                while k >= 0 and (node := step(node << 8 | window[k], 0)):
                    if (token := ends_at[node]) >= 0:
                        ending.append((k, token))
                    k -= 1
                for k, token in reversed(ending):
                    left = last[k - 1] if k else before
                    if left is None:
                        break
                    fits = known.get(left << 32 | token)
                    if fits or (fits is None and m.beside(left, token)):
                        break
                else:
                    raise ValueError("no token ends here: the vocabulary lacks a byte")
                last.append(token)
            if len(window) > m.lookahead + 4 * m.longest:
                out += self._stable()
        return out

    def _chain(self, n: int) -> Iterator[int]:
        while n > 0:
            yield n
            n -= len(self.merges.bytes_of[self.last[n - 1]])

    def _stable(self) -> list[int]:
        """The tokens that end a lookahead or more before the last byte seen."""
        n = len(self.window)
        return self._emit(next((k for k in self._chain(n) if k <= n - self.merges.lookahead), 0))

    def _emit(self, upto: int) -> list[int]:
        tokens = [self.last[n - 1] for n in self._chain(upto)][::-1]
        if upto:
            self.before = tokens[-1]
            self.window, self.last = self.window[upto:], self.last[upto:]
        return tokens

    def finish(self) -> list[int]:
        tokens = self._emit(len(self.window))
        self.reset()
        return tokens

    def whole(self, data: bytes) -> list[int]:
        """feed and finish for a piece that fits the window, where nothing is emitted before its end: the same rule,
        worked out only for the places that the chain from the end asks about."""
        m = self.merges
        step, ends_at, known, length = m.back.get, m.ends_at, m._beside, m.bytes_of
        last: dict[int, int] = {}

        def ending_at(n: int) -> int:
            node, k, ending = 0, n - 1, []
            while k >= 0 and (node := step(node << 8 | data[k], 0)):
                if (token := ends_at[node]) >= 0:
                    ending.append((k, token))
                k -= 1
            while ending:
                k, token = ending.pop()
                if k:
                    left = last[k] if k in last else ending_at(k)
                    fits = known.get(left << 32 | token)
                    if not (m.beside(left, token) if fits is None else fits):
                        continue
                last[n] = token
                return token
            raise ValueError("no token ends here: the vocabulary lacks a byte")

        n, out = len(data), []
        while n:
            out.append(last[n] if n in last else ending_at(n))
            n -= len(length[out[-1]])
        return out[::-1]


class ByteToText:
    """UTF-8 decoder fed piecewise. State: the at most three bytes of a character not yet complete."""

    def __init__(self) -> None:
        self.pending = b""

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        keep = 0
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:  # a leading byte: is its character still short of bytes?
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                keep = back if back < need else 0
                break
            if byte < 0x80:
                break
        self.pending = data[len(data) - keep :] if keep else b""
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        text, self.pending = self.pending.decode("utf-8", "replace"), b""
        return text


class _Memo(dict):
    """Piece of text -> its ids packed as little-endian 32-bit integers, computed on first sight.

    Two generations of at most MEMO entries: pieces met again while a generation fills outlive the other.
    """

    def __init__(self, merges: MergeList):
        super().__init__()
        self.encoder = Encoder(merges)
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        encoder = self.encoder
        packed = self.older.get(piece)
        if packed is None:
            data = piece.encode("utf-8", "replace")
            ids = encoder.whole(data) if len(data) <= 64 else encoder.feed(data) + encoder.finish()
            packed = b"".join(i.to_bytes(4, "little") for i in ids)
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


def _understood(spec: dict) -> None:
    """Refuse a file with settings that would change the tokens and that this machine does not implement."""
    model, pre, after = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
    odd += [k for k in ("byte_fallback", "ignore_merges") if model.get(k)]
    odd += ["model"] * (model.get("type", "BPE") != "BPE") + ["normalizer"] * bool(spec.get("normalizer"))
    odd += ["pre_tokenizer"] * (pre.get("type") != "ByteLevel" or bool(pre.get("add_prefix_space")) or not pre.get("use_regex", True))
    odd += ["decoder"] * (after.get("type") != "ByteLevel")
    odd += [f"added token {t['content']!r}" for t in spec.get("added_tokens", []) if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") and spec.get("normalizer")]
    if odd:
        raise ValueError("not a plain byte-level BPE file: " + ", ".join(odd))


class Tokenizer:
    """Reads a byte-level BPE file of the tokenizers library; no part of that library runs."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _understood(spec)
        byte = _byte_symbols()
        raw = lambda s: bytes(byte[c] for c in s)
        model = spec["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = MergeList({raw(s): i for s, i in model["vocab"].items() if all(c in byte for c in s)}, [(raw(a), raw(b)) for a, b in pairs])
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.memo = _Memo(self.merges)
        table = self.merges.bytes_of | {i: s.encode() for s, i in self.added.items()}
        self.table = [table.get(i, b"") for i in range(max(table) + 1)]

    def _sections(self, text: str) -> Iterable[tuple[str, bool]]:
        if self.cut is None or not any(s in text for s in self.added):
            return [(text, False)]
        return [(part, k % 2 == 1) for k, part in enumerate(self.cut.split(text)) if part]

    def packed(self, text: str) -> Iterator[bytes]:
        """Ids of `text`, run by run, as little-endian 32-bit integers."""
        memo = self.memo
        for part, added in self._sections(text):
            if added:
                yield self.added[part].to_bytes(4, "little")
            elif len(part) <= 4 * RUN:
                yield b"".join(map(memo.__getitem__, self.split.findall(part)))
            else:
                found = (m.group() for m in self.split.finditer(part))
                while run := list(islice(found, RUN)):
                    yield b"".join(map(memo.__getitem__, run))

    def encode(self, text: str) -> list[int]:
        return [i for run in self.packed(text) for i in memoryview(run).cast("I").tolist()]

    def decoded(self, runs: Iterable[list[int]]) -> Iterator[str]:
        """Text of ids, run by run."""
        machine, table = ByteToText(), self.table
        for ids in runs:
            yield machine.feed(b"".join(map(table.__getitem__, ids)))
        yield machine.finish()

    def decode(self, ids: list[int]) -> str:
        return "".join(self.decoded([ids]))


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """One per Python worker: the memos live as long as it does."""
    return Tokenizer(path)


def encode_documents(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of `docs`; with `ids` also ids and decoded.

    Whole texts are encoded and their ids decoded again, run by run. Null text counts as empty: no tokens,
    and the digests of nothing. Added tokens of the file that stand in a text become their ids. Repeated rows
    and null ids pass through; other columns are ignored. `path` must be readable on the executors.
    """
    import pyarrow as pa

    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if ids:
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
    schema = pa.schema(fields)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tokenizer(path)
        for batch in batches:
            rows: dict[str, list] = {name: [] for name, _ in fields}
            for doc_id, cell in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text, n = cell.as_py() or "", 0
                of_ids, of_text = hashlib.sha256(), hashlib.sha256()
                all_ids: list[int] = []
                all_text: list[str] = []

                def runs() -> Iterator[list[int]]:
                    nonlocal n
                    for run in codec.packed(text):
                        of_ids.update(run)
                        n += len(run) // 4
                        yield (numbers := memoryview(run).cast("I").tolist())
                        if ids:
                            all_ids.extend(numbers)

                for piece in codec.decoded(runs()):
                    of_text.update(piece.encode("utf-8"))
                    if ids:
                        all_text.append(piece)
                values = [doc_id, n, of_ids.hexdigest(), of_text.hexdigest(), *([all_ids, "".join(all_text)] if ids else [])]
                for name, value in zip(rows, values):
                    rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(work, ddl)
