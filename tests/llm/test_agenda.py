"""The agenda of short chunks, a list, against the heap of long ones and the library."""

import random

import public_tokenizers
import pytest

from copse.llm import sentencepiece_bpe as sp


def test_short_chunks_need_no_heap(monkeypatch):
    agenda = sp.Agenda(public_tokenizers.path(sp.MODEL))
    r = random.Random(3)
    chunks = [sp.SPACE + "".join(r.choice("aeinorst" if k % 2 else "abcdefghijklmnopqrstuvwxyzäéßÑ中é0123456789") for _ in range(k % 40)) for k in range(2000)]
    chunks += ["a", "aaaaaaa", sp.SPACE * 7, "\U0001f600", "------", "x" * sp.SHORT, "x" * (sp.SHORT + 1)]
    mine = [agenda.merge(c) for c in chunks]
    monkeypatch.setattr(sp, "SHORT", 0)  # the heap for all
    assert mine == [agenda.merge(c) for c in chunks]
    monkeypatch.undo()
    monkeypatch.setattr(sp, "heapify", lambda agenda: pytest.fail("a heap for a short chunk"))
    assert [agenda.merge(c) for c in chunks if len(c) <= sp.SHORT] == [ids for c, ids in zip(chunks, mine, strict=True) if len(c) <= sp.SHORT]
    agenda.fresh = list(zip(chunks, mine, strict=True))
    agenda.odd = {c: t for c, ids in agenda.fresh if (t := agenda.text_of(ids)) != c.replace(sp.SPACE, " ")}
    agenda.check()
