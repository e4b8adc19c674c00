"""Subsequence matching of short strings."""


def fuzzy_score(text, needle):
    """Extra span of the leftmost subsequence match of ``needle`` in ``text`` regardless of case, less 100 if it begins the text.

    None without a match; smaller is better; the empty needle has the largest int.
    """
    if text is None or needle is None:
        return None
    if not needle:
        return 2**31 - 1
    low, first, at = text.lower(), None, -1
    for c in needle.lower():
        at = low.find(c, at + 1)
        if at < 0:
            return None
        first = at if first is None else first
    return max(0, at - first + 1 - len(needle.lower())) - (100 if first == 0 else 0)
