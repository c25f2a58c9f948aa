"""Pieces of DuckDB SQL that several query modules share: normal form, sentences, stemmed tokens of ``text``."""

from __future__ import annotations

from ..functions import text as T

NORM = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
SENTENCES = rf"string_split(regexp_replace({NORM}, '([.!?]) ', '\1' || chr(1), 'g'), chr(1))"
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOP_WORDS)
TOKENS = rf"list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 1 and w not in ({_STOP})), lambda w: regexp_replace(w, '^(.{{4,}}?)({'|'.join(T.SUFFIXES)})$', '\1'))"
