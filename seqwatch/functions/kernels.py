"""Recursions over sequences of an explicit-duration hidden semi-Markov model, in log space.

`look` (T, K) has the log likelihood of each tick in each state, `pmf` and `survival` (K, D) the log probabilities of
durations 1..D. The last segment is cut off by the end of the sequence, so its duration counts by survival.

The work is done on many sequences at once, `look` (T, K, B): a tick costs a few calls for all of them. Sequence b has
`n[b]` ticks, what is beyond them is padding, and no result of a sequence depends on the others or on its padding.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Ticks times states of the sequences that go through a recursion together, padding included.
BATCH_CELLS = 1 << 19


def batches(lengths: np.ndarray, states: int) -> Iterator[np.ndarray]:
    """The numbers of all sequences in batches of similar lengths, each of at most `BATCH_CELLS` or of one sequence."""
    order = np.argsort(-np.asarray(lengths), kind="stable")
    at = 0
    while at < len(order):
        size = max(1, BATCH_CELLS // max(1, states * int(lengths[order[at]])))
        yield order[at : at + size]
        at += size


def stacked(sequences: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of numbers as columns, (T, B) with zeros beyond their ends, and their lengths."""
    n = np.array([len(s) for s in sequences])
    out = np.zeros((n.max(), len(n)), int)
    for b, s in enumerate(sequences):
        out[: len(s), b] = s
    return out, n


def columns(*sequences: Sequence[np.ndarray], states: int) -> Iterator[tuple]:
    """(numbers of the sequences, each kind of them stacked, their lengths) by batches; a sequence's kinds are equally long."""
    for some in batches([len(s) for s in sequences[0]], states):
        tables = [stacked([kind[b] for b in some]) for kind in sequences]
        yield some, *(table for table, _ in tables), tables[0][1]


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def filter_step(window: np.ndarray, look: np.ndarray, trans: np.ndarray, pmf: np.ndarray, survival: np.ndarray):
    """One tick of the causal filter: (log belief before the tick, log weight of all ticks so far, new window).

    window (D, K) has the weight of segments that began r ticks ago, their likelihood included. It is all the state
    that the filter needs, in batch and in streams. All arrays may have one more axis, of sequences.
    """
    pmf, survival = pmf.swapaxes(0, 1), survival.swapaxes(0, 1)
    before = lse(window + survival, 0)
    belief = before - lse(before, 0)
    window = window + look
    total = lse(lse(window + survival, 0), 0)
    ended = lse(window + pmf, 0)
    fresh = lse(ended[:, None] + trans, 0)
    return belief, total, ended, np.concatenate([fresh[None], window[:-1]])


def first_window(init: np.ndarray, d_max: int) -> np.ndarray:
    window = np.full((d_max, *init.shape), -np.inf)
    window[0] = init
    return window


def forward_all(look, n, init, trans, pmf, survival):
    """(beliefs (T, K, B), ended (T, K, B), fresh starts (T, K, B), log likelihoods (B,))."""
    window = first_window(np.repeat(init[:, None], len(n), 1), pmf.shape[1])
    trans, pmf, survival = trans[..., None], pmf[..., None], survival[..., None]
    beliefs, ends, starts, total = np.empty(look.shape), np.empty(look.shape), np.empty(look.shape), np.full(len(n), -np.inf)
    for t, x in enumerate(look):
        starts[t] = window[0]
        beliefs[t], weight, ends[t], window = filter_step(window, x, trans, pmf, survival)
        total = np.where(t == n - 1, weight, total)
    return beliefs, ends, starts, total


def forward(look, init, trans, pmf, survival):
    """(beliefs (T, K), ended (T, K), fresh starts (T, K), log likelihood)."""
    *found, total = forward_all(look[..., None], np.array([len(look)]), init, trans, pmf, survival)
    return *(x[..., 0] for x in found), float(total[0])


def likelihoods(look, n, init, trans, pmf, survival) -> np.ndarray:
    """Log likelihoods (B,) alone."""
    window = first_window(np.repeat(init[:, None], len(n), 1), pmf.shape[1])
    pmf, survival, total = pmf.T[..., None], survival.T[..., None], np.full(len(n), -np.inf)
    for t, x in enumerate(look):
        window = window + x
        done = np.flatnonzero(n - 1 == t)
        if len(done):
            total[done] = lse(lse(window[..., done] + survival, 0), 0)
        if t + 1 < len(look):
            ended = lse(window + pmf, 0)
            window = np.concatenate([lse(ended[:, None] + trans[..., None], 0)[None], window[:-1]])
    return total


def stacked_likelihoods(look, init, trans, pmf, survival) -> np.ndarray:
    """Log likelihoods (R,) of one sequence under R models: init (R, K), trans (R, K, K), pmf and survival (R, K, D)."""
    n = np.array([len(look)])
    return np.array([likelihoods(look[..., None], n, *tables)[0] for tables in zip(init, trans, pmf, survival)])


def expectations_all(look, n, init, trans, pmf, survival):
    """Expected statistics of each sequence: transitions (K, K, B), closed durations (K, D, B), the open one (K, D, B),
    occupancy (T, K, B), log likelihoods (B,)."""
    size, k, many = look.shape
    d_max = pmf.shape[1]
    _, ends, starts, total = forward_all(look, n, init, trans, pmf, survival)
    trans, pmf, survival = trans[..., None], pmf.T[..., None], survival.T[..., None]
    sums = np.concatenate([np.zeros((1, k, many)), np.cumsum(look, 0)])
    after = np.full((size, k, many), -np.inf)  # of what follows a segment that ends at t
    after[n - 1, :, np.arange(many)] = 0.0
    begin = np.full((size + 1, k, many), -np.inf)  # of a segment that begins at u and all after it
    closed, open_, gamma = np.zeros((d_max, k, many)), np.zeros((d_max, k, many)), np.zeros((size + 1, k, many))
    for u in range(size - 1, -1, -1):
        m = min(d_max, size - u)
        last = np.arange(u, u + m)[:, None, None]
        ended_here = last == n - 1
        weight = np.where(ended_here, survival[:m], pmf[:m]) + sums[u + 1 : u + m + 1] - sums[u] + after[u : u + m]
        begin[u] = lse(weight, 0)
        if u:
            after[u - 1] = np.where(u == n, after[u - 1], lse(trans + begin[u][None], 1))
        q = np.exp(starts[u] + weight - total)
        closed[:m] += np.where(ended_here, 0.0, q)
        open_[:m] += np.where(ended_here, q, 0.0)
        gamma[u] += q.sum(0)
        gamma[u + 1 : u + m + 1] -= q
    xi = np.zeros((k, k, many))
    for t in range(size - 1):
        xi += np.exp(ends[t][:, None] + trans + begin[t + 1][None] - total)
    return xi, closed.swapaxes(0, 1), open_.swapaxes(0, 1), np.cumsum(gamma, 0)[:size], total


def expectations(look, init, trans, pmf, survival):
    """The same of one sequence: transitions (K, K), closed durations (K, D), the open one (K, D), occupancy (T, K), log
    likelihood."""
    *found, total = expectations_all(look[..., None], np.array([len(look)]), init, trans, pmf, survival)
    return *(x[..., 0] for x in found), float(total[0])


def viterbi_all(look, n, init, trans, pmf, survival):
    """The likeliest segments that tile each sequence, ties to the lowest index: (segments of each sequence (B,), states and
    durations of all segments, sequence by sequence, log weights (B,))."""
    size, k, many = look.shape
    window = first_window(np.repeat(init[:, None], many, 1), pmf.shape[1])
    pmf, survival = pmf.T[..., None], survival.T[..., None]
    closed, previous = np.zeros((size, k, many), np.int32), np.full((size, k, many), -1, np.int32)
    state, back, best = np.zeros(many, int), np.zeros(many, int), np.empty(many)
    for t in range(size):
        window = window + look[t]
        done = np.flatnonzero(n - 1 == t)
        if len(done):
            final = window[..., done] + survival
            state[done], best[done] = final.max(0).argmax(0), final.max((0, 1))
            back[done] = final.argmax(0)[state[done], np.arange(len(done))]
        with_pmf = window + pmf
        closed[t] = with_pmf.argmax(0)
        step = with_pmf.max(0)[:, None] + trans[..., None]
        if t + 1 < size:
            previous[t + 1] = step.argmax(0)
            window = np.concatenate([step.max(0)[None], window[:-1]])
    at, end, rounds = np.arange(many), n - 1, []
    while len(at):  # all sequences go one segment back
        rounds.append((at, state, back + 1))
        begin = end - back
        more = begin > 0
        at, begin, state = at[more], begin[more], state[more]
        state, end = previous[begin, state, at].astype(int), begin - 1
        back = closed[end, state, at].astype(int)
    owner, states, durations = (np.concatenate(x) for x in zip(*rounds))
    order = np.lexsort((-np.repeat(np.arange(len(rounds)), [len(r[0]) for r in rounds]), owner))
    return np.bincount(owner, minlength=many), states[order], durations[order], best


def viterbi(look, init, trans, pmf, survival) -> tuple[list[tuple[int, int]], float]:
    """The likeliest segments (state, duration) that tile one sequence, and their log weight; ties to the lowest index."""
    _, states, durations, best = viterbi_all(look[..., None], np.array([len(look)]), init, trans, pmf, survival)
    return list(zip(states.tolist(), durations.tolist())), float(best[0])


def hmm_expectations_all(symbols, n, init, trans, emit):
    """Expected statistics of a plain HMM over symbols (T, B): gamma (T, K, B), zero beyond the ends, transitions (K, K, B),
    log likelihoods (B,)."""
    look = np.ascontiguousarray(emit[:, symbols].swapaxes(0, 1))
    size, k, many = look.shape
    trans = trans[..., None]
    alpha, beta, xi = np.empty(look.shape), np.zeros(look.shape), np.zeros((k, k, many))
    alpha[0] = init[:, None] + look[0]
    for t in range(1, size):
        alpha[t] = lse(alpha[t - 1][:, None] + trans, 0) + look[t]
    for t in range(size - 2, -1, -1):
        beta[t] = np.where(t < n - 1, lse(trans + (look[t + 1] + beta[t + 1])[None], 1), 0.0)
    total = lse(alpha[n - 1, :, np.arange(many)].T, 0)
    for t in range(size - 1):
        xi += np.where(t < n - 1, np.exp(alpha[t][:, None] + trans + (look[t + 1] + beta[t + 1])[None] - total), 0.0)
    inside = (np.arange(size)[:, None] < n)[:, None]
    return np.where(inside, np.exp(alpha + beta - total), 0.0), xi, total


def hmm_expectations(symbols, init, trans, emit):
    """The same of one sequence of symbols: gamma (T, K), transitions (K, K), log likelihood."""
    gamma, xi, total = hmm_expectations_all(np.asarray(symbols)[:, None], np.array([len(symbols)]), init, trans, emit)
    return gamma[..., 0], xi[..., 0], float(total[0])


#: Pairs of sequences whose edit distances are told together, and cells of a table of places.
PAIR_CELLS, PLACE_CELLS = 1 << 15, 1 << 22


def edit_matrix(texts: np.ndarray, n_texts: np.ndarray, patterns: np.ndarray, n_patterns: np.ndarray) -> np.ndarray:
    """The edit distance of each text (row) to each pattern (column).

    Sequences are columns of symbols, as `stacked` makes them. A text's symbol is one step for all pairs: the differences
    of the distances of a pattern's successive prefixes, each -1, 0 or 1, are bits of words of 64 (Myers; carries as in
    Hyyrö).
    """
    known = np.unique(patterns)
    out = np.empty((len(n_texts), len(n_patterns)), np.int32)
    at = np.searchsorted(known, texts)
    seen = np.where(known[np.minimum(at, len(known) - 1)] == texts, at, len(known)) if len(known) else np.zeros_like(texts)
    numbers, words = np.searchsorted(known, patterns), np.maximum(1, -(-n_patterns // 64))
    order = np.argsort(words, kind="stable")
    while len(order):
        w = int(words[order[0]])
        some = order[: max(1, PLACE_CELLS // ((len(known) + 1) * w))]
        some = some[words[some] == w]
        order = order[len(some) :]
        _edits(seen, n_texts, numbers[:, some], n_patterns[some], len(known) + 1, w, some, out)
    return out


def _edits(texts, n_texts, patterns, n_patterns, symbols, words, some, out) -> None:
    one, high, full = np.uint64(1), np.uint64(63), ~np.uint64(0)
    places = np.zeros((words, symbols, len(some)), np.uint64)
    for i in range(int(n_patterns.max(initial=0))):
        has = np.flatnonzero(n_patterns > i)
        places[i >> 6, patterns[i, has], has] |= one << np.uint64(i & 63)
    bits = np.clip(n_patterns - 64 * np.arange(words)[:, None], 0, 64).astype(np.uint64)
    within = np.where(bits > 0, full >> (np.uint64(64) - np.maximum(bits, one)), np.uint64(0))
    order = np.argsort(-n_texts, kind="stable")
    step = max(1, PAIR_CELLS // (len(some) * words))
    for rows in (order[lo : lo + step] for lo in range(0, len(order), step)):
        length, text = n_texts[rows], texts[:, rows]
        more, less = np.full((words, len(rows), len(some)), full), np.zeros((words, len(rows), len(some)), np.uint64)
        buffers = [np.empty((len(rows), len(some)), np.uint64) for _ in range(4)]
        for t in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -t))  # texts with a symbol here
            up, down = one, None
            eq, v, p, m = (b[:n] for b in buffers)
            for w in range(words):
                pv, mv = more[w, :n], less[w, :n]
                np.take(places[w], text[t, :n], axis=0, out=eq, mode="clip")
                np.bitwise_or(eq, mv, out=v)
                if down is not None:
                    eq |= down
                np.bitwise_and(eq, pv, out=p)
                p += pv
                p ^= pv
                p |= eq
                np.bitwise_and(pv, p, out=m)
                p |= pv
                np.invert(p, out=p)
                p |= mv
                carry = (p >> high, m >> high) if w + 1 < words else (None, None)
                p <<= one
                p |= up
                m <<= one
                if down is not None:
                    m |= down
                np.bitwise_and(p, v, out=mv)
                p |= v
                np.invert(p, out=p)
                np.bitwise_or(p, m, out=pv)
                up, down = carry
        found = np.repeat(length[:, None].astype(np.int32), len(some), 1)
        for w in range(words):
            found += np.bitwise_count(more[w] & within[w])
            found -= np.bitwise_count(less[w] & within[w])
        out[np.ix_(rows, some)] = found
