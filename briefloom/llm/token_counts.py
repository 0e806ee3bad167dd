"""Token counts by batch encoding that returns lengths only.

Arrow batches are cut into requests of about equal bytes. A long text is split first, at single spaces between two
other characters: no piece of the vocabulary holds the space mark behind another character, and the encoder puts a
mark in front of each part, so that the parts have exactly the tokens of the whole. Token ids stay in the worker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefloom.llm.common import map_batches

REQUEST_BYTES = 1 << 18
PART_CHARS = 1 << 14
_MARK = "▁"
_MODELS: dict[str, tuple] = {}


def _model(path: str):
    """The encoder, and whether texts may be split: loaded once per worker."""
    if path not in _MODELS:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        inner = any(_MARK in p.lstrip(_MARK) for p in pieces)
        # A mark in front of each text, and inner spaces kept: both are seen in the pieces of two short texts.
        fits = model.encode("a", out_type=str)[:1] == [_MARK + "a"] and model.encode("a  b", out_type=str) == [_MARK + "a", _MARK, _MARK + "b"]
        _MODELS[path] = model, fits and not inner
    return _MODELS[path]


def parts(text: str, chars: int = PART_CHARS) -> list[str]:
    """Split at safe spaces, each part about ``chars`` long; a stretch without a safe space stays whole."""
    out, start = [], 0
    while len(text) - start > chars:
        at = start + chars
        while True:
            at = text.find(" ", at)
            if at < 0 or at + 1 >= len(text):
                return [*out, text[start:]]
            if text[at - 1] not in (" ", _MARK) and text[at + 1] not in (" ", _MARK):
                break
            at += 1
        out.append(text[start:at])
        start = at + 1
    return [*out, text[start:]]


def count_tokens(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, request_bytes: int = REQUEST_BYTES
) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` of every whole text, without begin, end or added special tokens.

    Null and empty texts have 0 bytes and 0 tokens. ``over_limit``: more than ``limit`` tokens. One row per input row,
    repeated rows included, null identifiers pass through; other columns are not read. No shuffle. ``model`` is a path
    that every executor can open.
    """

    def rows(texts: list[str]) -> dict[str, list]:
        encode, may_split = _model(model)
        sizes, counts = [len(x.encode()) for x in texts], [0] * len(texts)
        request: list[str] = []
        owners: list[int] = []
        held = 0

        def send() -> None:
            for i, ids in zip(owners, encode.encode(request, num_threads=1)):
                counts[i] += len(ids)
            request.clear()
            owners.clear()

        for i, text in enumerate(texts):
            for part in parts(text) if may_split and len(text) > PART_CHARS else [text]:
                request.append(part)
                owners.append(i)
                held += len(part.encode())
                if held >= request_bytes:
                    send()
                    held = 0
        send()
        return {"n_bytes": sizes, "n_tokens": counts}

    return map_batches(docs, id_col, text_col, "n_bytes long, n_tokens long", rows).withColumn("over_limit", F.col("n_tokens") > limit)
