"""Ids of code elements."""

import hashlib


def element_id(kind, *parts):
    return f"{kind}_{hashlib.sha256('/'.join((kind, *parts)).encode()).hexdigest()[:16]}"
