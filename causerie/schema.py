"""The interchange document: a text and flat lists of standoff spans (code points, half-open)."""

from __future__ import annotations

import pyarrow as pa

CUE = "struct<start:int,end:int>"
REPLICA = f"struct<start:int,end:int,speaker:string,addressee:string,qtype:string,cue:{CUE},mode:string>"
CHARACTER = "struct<id:string,name:string,aliases:array<string>,gender:string>"
MENTION = "struct<start:int,end:int,char:string>"
DOC = f"doc_id string, lang string, domain string, source string, license string, text string, replicas array<{REPLICA}>, characters array<{CHARACTER}>, mentions array<{MENTION}>"
DOC_STRUCT = "struct<" + DOC.replace(" string,", ":string,").replace(" array", ":array") + ">"
_CUE = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_TEXTS = [(n, pa.string()) for n in ("doc_id", "lang", "domain", "source", "license", "text")]
_SAID = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("speaker", pa.string()), ("addressee", pa.string()), ("qtype", pa.string()), ("cue", _CUE), ("mode", pa.string())])
_PERSON = pa.struct([("id", pa.string()), ("name", pa.string()), ("aliases", pa.list_(pa.string())), ("gender", pa.string())])
_NAMED = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("char", pa.string())])
#: DOC in Arrow's types.
DOC_ARROW = pa.schema([*_TEXTS, ("replicas", pa.list_(_SAID)), ("characters", pa.list_(_PERSON)), ("mentions", pa.list_(_NAMED))])
QTYPES = tuple("anaphoric explicit implicit".split())
DOMAINS = ("prose", "drama")
#: The speaker of a line that nobody is known to say, in gold and in predictions.
NOBODY = "none"
