"""Plain restatement of the per-frame rules, one frame at a time, for the tests."""


def emissions(frames, hold=30, flush=False):
    """``frames``: list of {track: crossed}; returns {track: (cross, emit)}."""
    crossed, sent, previous = {}, {}, set()
    for at, seen in enumerate(frames):
        if set(seen) != previous:
            for track in [t for t in crossed if t not in sent and t not in seen]:
                sent[track] = (crossed[track][0], at)
            previous = set(seen)
        for track, over in seen.items():
            if track in crossed and track not in sent:
                crossed[track][1] -= 1
                if crossed[track][1] == 0:
                    sent[track] = (crossed[track][0], at)
            if over and track not in crossed:
                crossed[track] = [at, hold]
    if flush:
        for track, (at, left) in crossed.items():
            if track not in sent:
                sent[track] = (at, len(frames))
    return sent


def kept_frames(has_person, after=10, drop=31):
    kept, empty, skip = [], 0, 0
    for at, has in enumerate(has_person):
        if skip:
            skip -= 1
            continue
        kept.append(at)
        empty = 0 if has else empty + 1
        if empty >= after:
            empty, skip = 0, drop
    return kept


def random_frames(rng, n, tracks, stay=0.85, cross=0.1):
    """Tracks that come and go; a few frames are empty."""
    seen, frames = set(), []
    for _ in range(n):
        seen = {t for t in range(tracks) if (rng.random() < stay) == (t in seen)}
        frames.append({t: rng.random() < cross for t in sorted(seen)})
    return frames
