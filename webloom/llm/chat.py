"""Chat formatting at token level.

Each segment (a role or a text) is encoded on its own, so no token crosses a border and
no text can yield a reserved id. Reserved ids are spliced in between, the loss mask comes
from prefix sums over segment lengths, and control strings that occur in a text are
broken up with a backslash, reversibly.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary is read from by default; callers may name another file.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The template's control strings. Each has one reserved id after the vocabulary's.
HEADERS = {"system": "### System:", "user": "### User:", "assistant": "### Assistant:", "tool": "### Tool:"}
OTHER, BODY, END = "### Role:", "### Body:", "</turn>"
CONTROLS = (*HEADERS.values(), OTHER, BODY, END)
# Fixed value: the public split pattern of byte-level vocabularies of this kind.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_BREAK = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))


def escape(text: str) -> str:
    """Double backslashes, then put one after the first character of each control string."""
    return _BREAK.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """The inverse of ``escape``: a backslash stands for the next backslash, or for nothing."""
    return re.sub(r"\\(\\?)", r"\1", text)


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file's bytes, read once by the driver and sent to the executors."""
    with open(path, "rb") as f:
        return f.read()


class Template:
    """A vocabulary with the template's reserved ids after it."""

    def __init__(self, vocabulary: bytes) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.coder = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        first = max(ranks.values()) + 1
        self.ids = {c: first + i for i, c in enumerate(CONTROLS)}
        self.names = {i: c for c, i in self.ids.items()}

    def encode(self, text: str) -> list[int]:
        """Ordinary ids of an escaped segment, piecewise so that no piece is very long.

        Pieces end before a space or line break; a run of over 20,000 characters without
        one is cut there, which changes ids but not what they decode to.
        """
        out: list[int] = []
        for piece in re.findall(r"(?s).{1,4000}(?=[ \n]|\Z)|.{1,20000}", text) if len(text) > 4000 else [text]:
            out += self.coder.encode_ordinary(piece)
        return out

    def decode(self, ids) -> str:
        return self.coder.decode_bytes([int(i) for i in ids]).decode("utf-8")

    def assemble(self, turns: list[tuple[str, list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask of turns (role, the ids of the role if it has no header, the ids of the text)."""
        segments: list[tuple[list[int], bool]] = []
        for role, named, body in turns:
            if role in HEADERS:
                segments.append(([self.ids[HEADERS[role]]], False))
            else:
                segments += [([self.ids[OTHER]], False), (named, False), ([self.ids[BODY]], False)]
            segments += [(body, role == "assistant"), ([self.ids[END]], False)]
        ends = np.cumsum([len(ids) for ids, _ in segments], dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        change = np.zeros(total + 1, dtype=np.int64)
        for (ids, loss), end in zip(segments, ends, strict=True):
            if loss:
                change[end - len(ids)] += 1
                change[end] -= 1
        ids = np.fromiter((i for part, _ in segments for i in part), dtype=np.int64, count=total)
        return ids, np.cumsum(change)[:total].astype(bool)

    def turns(self, ids: np.ndarray) -> list[tuple[str, str]]:
        """(role, text) of each turn, read back from formatted ids."""
        out, at = [], 0
        special = np.flatnonzero(ids >= min(self.names))
        while at < len(special):
            name = self.names[int(ids[special[at]])]
            if name == OTHER:
                role = unescape(self.decode(ids[special[at] + 1 : special[at + 1]]))
                at += 1
            else:
                role = next(r for r, c in HEADERS.items() if c == name)
            out.append((role, unescape(self.decode(ids[special[at] + 1 : special[at + 1]]))))
            at += 2
        return out

    def loss_text(self, ids: np.ndarray, mask: np.ndarray) -> str:
        """All text under the mask, unescaped, run by run."""
        edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
        return "".join(unescape(self.decode(ids[a:b])) for a, b in zip(edges[::2], edges[1::2], strict=True))

    def text(self, ids: np.ndarray) -> str:
        """The formatted text: reserved ids as their control strings."""
        special = np.flatnonzero(ids >= min(self.names))
        out, at = [], 0
        for s in special:
            out += [self.decode(ids[at:s]), self.names[int(ids[s])]]
            at = s + 1
        return "".join([*out, self.decode(ids[at:])])


def _template(sent):
    """The task's template; built once for each Python worker."""
    held = getattr(_template, "held", None)
    if held is None or held[0] != (key := hash(sent.value)):
        held = _template.held = (hash(sent.value), Template(sent.value))
    return held[1]


def format_chats(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Formatted conversations: conv_id, ids array<int>, loss_mask array<boolean>.

    ``turns``: conv_id, turn, role, text; other columns are ignored. Rows are ordered by
    turn, equal turns by role and text (nulls first), and repeated rows all count. Null
    texts and roles count as empty; a role without a header of its own is written into the
    output and read back. Null conv_ids form one conversation. Encoding runs row by row
    before the shuffle; a conversation is one training example and is put together whole.
    """
    spark = turns.sparkSession
    sent = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    def encode(batches):
        own = _template(sent)
        for b in batches:
            yield pd.DataFrame({
                "conv_id": b["conv_id"], "turn": b["turn"], "role": b["role"], "text": b["text"],
                "named": [[] if r in HEADERS else own.encode(escape(r)) for r in b["role"]],
                "body": [own.encode(escape(t)) for t in b["text"]],
            })

    rows = turns.select(F.col("conv_id").cast("long").cast("string").alias("conv_id"), F.col("turn").cast("long").cast("string").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    encoded = rows.mapInPandas(encode, "conv_id string, turn string, role string, text string, named array<int>, body array<int>")
    order = F.struct(F.col("turn").cast("long").alias("turn"), "role", "text", "named", "body")
    whole = encoded.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(order)).alias("t"))
    whole = whole.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("t.role").alias("roles"), F.col("t.named").alias("named"), F.col("t.body").alias("bodies"))

    def put_together(batches):
        own = _template(sent)
        for b in batches:
            made = [own.assemble(list(zip(r, n, t, strict=True))) for r, n, t in zip(b["roles"], b["named"], b["bodies"], strict=True)]
            yield pd.DataFrame({"conv_id": b["conv_id"], "ids": [x[0].astype(np.int32) for x in made], "loss_mask": [x[1] for x in made]})

    out = whole.mapInPandas(put_together, "conv_id string, ids array<int>, loss_mask array<boolean>")
    return out.withColumn("conv_id", F.col("conv_id").cast("long"))


def digests(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """What formatted conversations hold, read back from their ids and masks alone."""
    sent = formatted.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def read(batches):
        own = _template(sent)
        for b in batches:
            out = []
            for conv, ids, mask in zip(b["conv_id"], b["ids"], b["loss_mask"], strict=True):
                ids, mask = np.asarray(ids, dtype=np.int64), np.asarray(mask, dtype=bool)
                turns, loss = own.turns(ids), own.loss_text(ids, mask)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(own.text(ids)), len(ids)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"])

    text = formatted.withColumn("conv_id", F.col("conv_id").cast("string"))
    out = text.mapInPandas(read, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")
    return out.withColumn("conv_id", F.col("conv_id").cast("long"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that quotes the template's own control strings."""
    from webloom.llm.common import table

    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_chats(rows.unionByName(own))).drop("n_tokens")



OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), m AS (
  SELECT *,
    length(text) + length(text) - length(replace(text, '\', ''))
      + len(regexp_extract_all(text, '### (?:System|User|Assistant|Tool|Role|Body):|</turn>')) + length('</turn>')
      + CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN length('### :') + length(role)
        ELSE length('### Role:### Body:') + length(role) + length(role) - length(replace(role, '\', ''))
          + len(regexp_extract_all(role, '### (?:System|User|Assistant|Tool|Role|Body):|</turn>')) END AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""
