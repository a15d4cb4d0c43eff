"""Token counts by a finite-state transducer compiled from a byte-fallback BPE model.

The model's merges only depend on its pieces and their scores: of all neighbours whose
concatenation is a piece, the best score (then the leftmost) merges first. Two facts turn that into
a transducer over characters:

* A sequence of tokens is the encoding of its text if and only if each two neighbours are the
  encoding of theirs, so the last token of a prefix is the one piece ending there that is
  compatible with the last token of what precedes it.
* A state needs no more of the past than the places from which a piece may still be open: for each,
  its node in the trie of pieces, the last token before it, and how many tokens fewer there are
  before it than before the current place.

States are numbered as they are met (lazy determinisation); a transition is annotated with the
tokens that it emits, which may be negative when a merge takes some back. No piece has a space after
another character, and a character outside the pieces falls back to its bytes and joins nothing: at
both the automaton returns to its start, however it came there.

A text is cut into chunks of CHUNK characters, wherever that is. A chunk's map takes an entry state to
(tokens emitted, exit state); it is built without knowing what precedes the chunk, and remembers the
entries it has been asked for. Within the chunk all entries soon meet: where the automaton returns to
its start, or else at the first of the marks, every 64 characters, at which a run is in the state of
the run from the start. Maps compose associatively, and a text's chunks are composed by a prefix scan
by doubling, SCANNED maps at a time, so memory is that of the text and of these maps. All chunks of a
text, which is one row, are counted in one task.

Counts equal the library's encoding of the whole text, without begin and end tokens; strings of
special tokens are ordinary text; the dummy prefix is the model's.

Nulls: a null or empty text has no bytes and no tokens. A null doc_id is kept. Rows are counted each
for itself, repeated ones too; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import id_text, table, texts

SPACE = "▁"
LIMIT = 4096
#: Characters of a chunk, and between the marks of one in which the automaton never returns to its start; maps scanned at once.
CHUNK, MARK, SCANNED = 1 << 14, 64, 64
#: States and remembered words before the tables are emptied; results don't depend on them.
MOST_STATES, MOST_WORDS = 200_000, 800_000
#: Each piece begins where the automaton is at its start, whatever came before: after a line feed, at a space after another character.
WORD = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
NORMAL = 1


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Transducer:
    """The compiled model. A state is a dict: character -> (next state, tokens emitted)."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, spec = model.normalizer_spec, model.trainer_spec
        pieces = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        plain = norm.name == "identity" and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not spec.treat_whitespace_as_suffix
        known = {NORMAL, 2, 3, 6}
        if spec.model_type != 2 or not spec.byte_fallback or not plain or {p.type for p in model.pieces} - known or any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
            raise ValueError("only byte-fallback BPE models with identity normalisation and leading spaces are compiled")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.scores = pieces
        singles = [p for p in pieces if len(p) == 1]
        #: In order of merging; equal scores have equal places.
        ranks = {score: i for i, score in enumerate(sorted({s for p, s in pieces.items() if len(p) > 1}, reverse=True))}
        self.order = dict.fromkeys(singles, -1) | {p: ranks[s] for p, s in pieces.items() if len(p) > 1}
        self.split = {p: self._last_merge(p) for p in pieces if len(p) > 1}
        #: The trie of those pieces that their own text is encoded as: edges, and the piece that ends at a node.
        self.edges: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        for p in sorted(pieces):
            if len(p) > 1 and self.split[p] is None:
                continue
            node = 0
            for c in p:
                to = self.edges[node].get(c)
                if to is None:
                    to = self.edges[node][c] = len(self.edges)
                    self.edges.append({})
                    self.ends.append(None)
                node = to
            self.ends[node] = p
        self.compatible = functools.lru_cache(1 << 16)(self._compatible)
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, dict] = {}
        self.start = self._state(((0, "", 0),))
        self.free, self.spaced = Remembered(self, ""), Remembered(self, SPACE)

    def merged(self, text: str, until: int = 1) -> list[str]:
        """The model's own merges on a short text: what transitions are compiled from."""
        symbols, score = list(text), self.scores.get
        offers = [score(a + b) for a, b in zip(symbols, symbols[1:])]
        while True:
            best, at = None, -1
            for i, s in enumerate(offers):
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0 or len(symbols) <= until:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del offers[at]
            if at < len(offers):
                offers[at] = score(symbols[at] + symbols[at + 1])
            if at:
                offers[at - 1] = score(symbols[at - 1] + symbols[at])

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two tokens whose merge ends the encoding of a piece's own text; None if that isn't the piece."""
        parts = self.merged(piece, until=2)
        return (parts[0], parts[1]) if len(parts) == 2 and self.merged(piece) == [piece] else None

    def _compatible(self, left: str, right: str) -> bool:
        """If left and right stay apart when their texts are encoded together.

        Runs both merge histories backwards from the boundary: a merge across it would have come first
        if the two tokens that touch there make a piece that is merged before the next one of either side.
        """
        if not left:
            return True
        order, split = self.order, self.split
        limit = 1 << 60
        while True:
            across = order.get(left + right)
            if across is not None and across < limit:
                return False
            a, b = order[left], order[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, split[left][1]
            else:
                limit, right = b + 1, split[right][0]

    def _state(self, places: tuple) -> dict:
        """places: (trie node, last token before, tokens there less tokens now), for each place where a piece may begin."""
        found = self.states.get(places)
        if found is None:
            found = self.states[places] = {"": places}
        return found

    def step(self, state: dict, c: str) -> tuple[dict, int]:
        """Adds the transition for c, and returns it."""
        if c not in self.edges[0]:
            out = state[c] = (self.start, len(c.encode("utf-8", "surrogatepass")))
            return out
        places = state[""]
        if c == SPACE and places[-1][1].strip(SPACE):
            places = ((0, "", 0),)
        moved, last, count = [], None, 0
        for node, token, k in places:
            to = self.edges[node].get(c)
            if to is None:
                continue
            piece = self.ends[to]
            if last is None and piece is not None and self.compatible(token, piece):
                last, count = piece, k + 1
            if self.edges[to]:
                moved.append((to, token, k))
        assert last is not None, "a piece ends at every known character"
        kept = [(n, t, k - count) for n, t, k in moved]
        out = state[c] = (self._state((*kept, (0, last, 0))), count)
        return out

    def run(self, state: dict, text: str) -> tuple[dict, int]:
        """From state over text: the exit state and the tokens emitted."""
        total = 0
        for c in text:
            edge = state.get(c) or self.step(state, c)
            state = edge[0]
            total += edge[1]
        return state, total

    def word(self, text: str) -> int:
        """Tokens from start over a piece of WORD; what follows is again at the start."""
        return self.free[text] if text[:1] != SPACE else self.spaced[text[1:]]

    def renewed(self, state: dict) -> dict:
        """The state in emptied tables, if they have grown too large."""
        if len(self.states) <= MOST_STATES:
            return state
        self.states.clear()
        self.start = self._state(((0, "", 0),))
        return self._state(state[""])

    def parts(self, chunk: str) -> tuple[str, int, str | None]:
        """A chunk's text up to the first word that begins within it, the tokens of the words after it, and the last word, left open.

        The last is None if no word begins within.
        """
        if SPACE + SPACE in chunk or chunk[-1:] in (SPACE, "\n"):
            pieces = WORD.findall(chunk)
            if len(pieces) < 2:
                return chunk, 0, None
            return pieces[0], sum(map(self.word, pieces[1:-1])), pieces[-1]
        lines = [line.split(SPACE) for line in chunk.split("\n")]
        first = lines[0]
        if len(lines) == 1 and len(first) < (3 if first[0] == "" else 2):
            return chunk, 0, None
        # A space that begins the chunk may go on a run of spaces, so its word belongs to the head.
        head, taken = (SPACE + first[1], 2) if first[0] == "" and len(first) > 1 else (first[0], 1)
        last = lines[-1]
        tail = SPACE + last.pop() if len(last) > 1 else last.pop()
        free, spaced = self.free.__getitem__, self.spaced.__getitem__
        inner = sum(map(spaced, first[taken:]))
        for line in lines[1:]:
            inner += 1 + (free(line[0]) + sum(map(spaced, line[1:])) if line else 0)
        return head, inner, tail

    def scan(self, maps: list[ChunkMap | Composed]) -> list[ChunkMap | Composed]:
        """Inclusive prefix scan by doubling: each round composes all maps with the one `reach` before, each for itself."""
        reach = 1
        while reach < len(maps):
            maps = [m if i < reach else Composed(maps[i - reach], m) for i, m in enumerate(maps)]
            reach *= 2
        return maps

    def count(self, text: str) -> int:
        if not text:
            return 0
        if len(text) <= CHUNK:
            head, inner, tail = self.parts(self.prefix + text.replace(" ", SPACE))
            return self.word(head) + inner + (self.word(tail) if tail else 0)
        state, total = self.start, 0
        for at in range(0, len(text), CHUNK * SCANNED):
            chunks = [text[i : i + CHUNK].replace(" ", SPACE) for i in range(at, min(len(text), at + CHUNK * SCANNED), CHUNK)]
            if not at:
                chunks[0] = self.prefix + chunks[0]
            tokens, state = self.scan([ChunkMap(self, c) for c in chunks])[-1](state)
            total += tokens
            state = self.renewed(state)
        return total


class ChunkMap:
    """Entry state -> (tokens, exit state) of one chunk."""

    def __init__(self, machine: Transducer, chunk: str) -> None:
        self.machine, self.known = machine, {}
        self.head, inner, tail = machine.parts(chunk)
        self.marks: list[tuple[dict, int]] = []
        if tail is None:
            state, total = machine.start, 0
            for i in range(0, len(chunk), MARK):
                state, n = machine.run(state, chunk[i : i + MARK])
                total += n
                self.marks.append((state, total))
            self.known[machine.start[""]] = total, state
        else:
            self.exit, n = machine.run(machine.start, tail)
            self.rest = inner + n
            self.known[machine.start[""]] = machine.word(self.head) + self.rest, self.exit

    def __call__(self, entry: dict) -> tuple[int, dict]:
        found = self.known.get(entry[""])
        if found is None:
            found = self.known[entry[""]] = self._from(entry)
        return found

    def _from(self, entry: dict) -> tuple[int, dict]:
        if not self.marks:
            return self.machine.run(entry, self.head)[1] + self.rest, self.exit
        state, total = entry, 0
        for k, (met, upto) in enumerate(self.marks):
            state, n = self.machine.run(state, self.head[k * MARK : (k + 1) * MARK])
            total += n
            if state is met:
                return total + self.marks[-1][1] - upto, self.marks[-1][0]
        return total, state


class Composed:
    """The map of two neighbours: known for the entries that the first one knows, worked out for others."""

    def __init__(self, a: ChunkMap | Composed, b: ChunkMap | Composed) -> None:
        self.a, self.b = a, b
        self.known = {e: self._after(*found) for e, found in a.known.items()}

    def _after(self, tokens: int, state: dict) -> tuple[int, dict]:
        more, state = self.b(state)
        return tokens + more, state

    def __call__(self, entry: dict) -> tuple[int, dict]:
        found = self.known.get(entry[""])
        if found is None:
            found = self.known[entry[""]] = self._after(*self.a(entry))
        return found


class Remembered(dict):
    """Word -> tokens emitted from the start over `before` and the word: a path of the automaton kept as one transition."""

    def __init__(self, machine: Transducer, before: str) -> None:
        self.machine, self.before = machine, before

    def __missing__(self, word: str) -> int:
        machine = self.machine
        if len(machine.states) > MOST_STATES:
            machine.states.clear()
            machine.start = machine._state(((0, "", 0),))
        if len(self) > MOST_WORDS:
            self.clear()
        n = machine.run(machine.start, self.before + word)[1]
        if len(word) <= 64:
            self[word] = n
        return n


@functools.lru_cache(4)
def compiled(path: str) -> Transducer:
    return Transducer(path)


def counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(path)
        for batch in batches:
            sizes, counts = [], []
            for t in texts(batch):
                sizes.append(len(t))
                counts.append(machine.count(t.decode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. path: of the model, readable on every executor."""
    counted = id_text(docs).mapInArrow(counter(path or model_path()), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
