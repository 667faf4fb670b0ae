"""Queries that SQL cannot state, against the matcher, the tokenizer or their own rules on collected rows."""

import hashlib
import re
from difflib import SequenceMatcher

import pytest
from oracle import DATA

from loomtree.functions import bpe
from loomtree.plans import annotation_queries, state_queries

SF = f"{DATA}/sf0.001"


def words(text):
    for pattern in (r"(?s)<!--.*?-->", r"(?m)^\s*@\s*-+\s+.*$", r"(?s)\$\$.*?\$\$", r"\$[^$\n]*?\$"):
        text = re.sub(pattern, " ", text)
    return re.findall(r"[a-z0-9]{3,}", text.lower(), re.ASCII)


def expected(raw, cleaned):
    a, b = words(cleaned), [(w, n) for n, line in enumerate(raw.splitlines(), 1) for w in words(line)]
    least = min(20, len(b))
    if not b or len(a) < least:
        return None, None, 0, "raw_has_no_content_tokens" if not b else "cleaned_too_short_for_alignment"
    blocks = [m for m in SequenceMatcher(None, a, [w for w, _ in b], autojunk=False).get_matching_blocks() if m.size]
    if not blocks:
        return None, None, 0, "no_token_overlap"
    matched, end = sum(m.size for m in blocks), blocks[-1].b + blocks[-1].size
    return b[end - 1][1], matched / len(a), matched, None


def test_unequal_texts_are_aligned_as_the_matcher_aligns_them(spark):
    pairs = annotation_queries._unequal_pairs(spark, SF).collect()
    got = {(r.doc, r.chunk, r.cleaned_hash): r for r in annotation_queries.QUERIES["aln_5_unequal_texts"](spark, SF).collect()}
    assert len(pairs) > 10 and any(r.low_confidence for r in got.values())
    for p in pairs:
        r = got[p.doc, p.chunk, hashlib.md5(p.cleaned.encode()).hexdigest()]
        line, confidence, matched, code = expected(p.raw, p.cleaned)
        assert (r.cutoff_line, r.confidence, r.matched_token_count, r.error_code) == (line, pytest.approx(confidence) if confidence else None, matched, code)


def test_sessions_keep_their_rules_and_meet_the_matcher(spark):
    sessions = {r.doc: r for r in state_queries._sessions(spark, SF).collect()}
    submitted = {r.doc: r for r in state_queries.QUERIES["api_3_4_5_submit"](spark, SF).collect()}
    committed = {r.doc: r for r in state_queries.QUERIES["api_6_commit"](spark, SF).collect()}
    assert submitted.keys() == committed.keys() == sessions.keys() and any(r.valid for r in submitted.values())
    for doc, r in submitted.items():
        line, confidence, _, code = expected(sessions[doc].raw, sessions[doc].cleaned)
        assert r.inferred_cutoff_batch_line == line and r.match_confidence == (confidence and pytest.approx(confidence, abs=5e-4))
        assert r.valid == (not r.errors) and any("Alignment failed" in e for e in r.errors) == (code is not None)
        assert not (r.valid and "@" in sessions[doc].cleaned) or r.proposed_tree or "id=" not in sessions[doc].cleaned
        done = committed[doc]
        assert done.success == (r.valid and line is not None) and (done.error is None) == done.success
        start = sessions[doc].raw_start_line
        assert done.source_line == (start + line if done.success and start is not None else None)


def test_bpe_counts(spark):
    rows = {r.doc_id: r.n_tokens for r in annotation_queries.QUERIES["seg_7_bpe_tokens"](spark, SF).collect()}
    encode = bpe.encoding().encode_ordinary
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert rows == {r.doc_id: None if r.text is None else len(encode(r.text)) for r in texts}
