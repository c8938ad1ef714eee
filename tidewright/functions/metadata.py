"""Reading of attribute metadata, whatever its JSON layout."""

from __future__ import annotations

import json


def metadata_pairs(text: str | None) -> list[tuple[str, object]] | None:
    """(name, value) pairs in the order of the text; repeated names give repeated pairs.

    Layouts: an object, an object under the single key "fields", a list of {"attribute", "value"} objects, a list of
    [name, value] lists, and any of these once more as a JSON string. NULL, unreadable text and other JSON give None.
    """
    if text is None:
        return None
    try:
        data = json.loads(text, object_pairs_hook=_Pairs)
        if isinstance(data, str):
            data = json.loads(data, object_pairs_hook=_Pairs)
    except (ValueError, RecursionError):
        return None
    if isinstance(data, _Pairs):
        if len(data) == 1 and data[0][0] == "fields" and isinstance(data[0][1], list):
            data = data[0][1]
        if isinstance(data, _Pairs):
            return list(data)
    if not isinstance(data, list):
        return None
    pairs = []
    for entry in data:
        if isinstance(entry, _Pairs):
            got = dict(entry)
            if "attribute" not in got:
                return None
            pairs.append((got["attribute"], got.get("value")))
        elif isinstance(entry, list) and len(entry) == 2:
            pairs.append((entry[0], entry[1]))
        else:
            return None
    return [(n if isinstance(n, str) else json.dumps(n), v) for n, v in pairs]


class _Pairs(list):
    """The members of a JSON object, repeated names included."""
