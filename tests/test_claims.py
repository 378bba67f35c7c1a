from concurrent.futures import ThreadPoolExecutor

import pytest

from heddle.streaming.claims import Chunks
from heddle.streaming.ingest import job_states


def test_a_chunk_has_one_claimer_and_counts_once(spark, tmp_path):
    own = Chunks(spark, str(tmp_path), lease=100)
    assert own.create("j", 3) and not own.create("j", 9) and own.size("j") == 3
    a, b = own.claim("j", "a", now=0), own.claim("j", "b", now=0)
    assert (a.chunk, b.chunk, a.attempt) == (0, 1, 1)
    assert own.complete(b, "of b", now=1) and not own.complete(b, "again", now=2)
    late = own.claim("j", "c", now=50)
    assert late.chunk == 2 and own.claim("j", "d", now=60) is None
    # the lease of a runs out, is taken over, and what a brings then doesn't count
    assert own.renew(late, now=90)
    taken = own.claim("j", "d", now=100)
    assert (taken.chunk, taken.attempt) == (0, 2) and not own.complete(a, "of a", now=101) and not own.renew(a, now=101)
    assert own.complete(taken, "of d", now=102)
    assert own.claim("j", "e", now=150) is None and own.complete(late, "of c", now=189)
    assert own.claim("j", "e", now=10_000) is None
    assert sorted((r.chunk, r.result) for r in own.results().collect()) == [(0, "of d"), (1, "of b"), (2, "of c")]
    assert [(r.state, r.chunks, r.complete) for r in job_states(own.log()).collect()] == [("complete", 3, 3)]


def test_failures_are_tried_again_and_then_given_up(spark, tmp_path):
    own = Chunks(spark, str(tmp_path), attempts=2)
    own.create("j", 2)
    for attempt in (1, 2):
        claim = own.claim("j", "a", now=attempt)
        assert (claim.chunk, claim.attempt) == (0, attempt) and own.fail(claim, "no", now=attempt)
    assert own.claim("j", "a", now=3).chunk == 1 and own.claim("j", "a", now=4) is None
    (state,) = job_states(own.log()).collect()
    assert (state.state, state.complete, state.next_chunk) == ("failed", 0, None)
    with pytest.raises(ValueError, match="no such job"):
        own.claim("other", "a")


def test_claimers_at_the_same_time_never_share(spark, tmp_path):
    own = Chunks(spark, str(tmp_path))
    own.create("j", 12)

    def work(worker):
        got = []
        while claim := own.claim("j", worker):
            got.append(claim.chunk)
        return got

    with ThreadPoolExecutor(4) as pool:
        got = [c for part in pool.map(work, "abcd") for c in part]
    assert sorted(got) == list(range(12))
