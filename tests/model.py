"""Plain models to check the expressions against, by table or by enumeration."""


def contained(q, p, base, strict=False):
    """Containment of q in p, one case per combination of wrapping."""
    (qs, qe), (ps, pe) = q, p
    wraps = (pe < ps, qe < qs)
    if wraps == (False, False):
        return ps <= qs and qe <= pe
    if wraps == (False, True):
        return ps <= qs and qe + base <= pe
    if wraps == (True, True):
        return ps <= qs and qe <= pe
    if strict:
        turn = base if qs < ps else 0
        return ps <= qs + turn and qe + turn <= pe + base
    moved = [x + base if x < ps else x for x in (qs, qe)]
    return ps <= moved[0] and moved[1] <= pe + base


def spans(mask):
    """Maximal runs of set weekdays."""
    text = "".join("1" if mask >> d & 1 else "0" for d in range(7))
    found, start = [], 0
    for run in text.replace("01", "0 1").replace("10", "1 0").split():
        if run[0] == "1":
            found.append((start + 1, start + len(run)))
        start += len(run)
    return found
