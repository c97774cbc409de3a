"""License scans: template markup compiled into token automata.

A template is wording with marked regions: `<<opt>> ... <<end>>` may be absent, `<<var N>>` stands for up to N words
of any kind. Everything else is mandatory and has to match word for word. Templates are compiled to automata whose
transitions read one word; a text that an automaton accepts somewhere gets the template's label. Plain base phrases
are located beside them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import by_few, ship

ship(__name__)

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of public licenses and of the notices that point to them.
TEMPLATES = {
    "apache-2.0": "<<opt>>licensed under the<<end>> apache license <<opt>>version<<end>> 2.0",
    "cc-by-4.0": "cc by 4.0 <<opt>>international<<end>>",
    "cc-by-nc-4.0": "cc by nc 4.0 <<opt>>international<<end>>",
    "cc-by-sa-4.0": "cc by sa 4.0 <<opt>>international<<end>>",
    "gpl-2.0": "gnu general public license <<opt>>as published by the free software foundation either<<end>> version 2",
    "gpl-3.0": "gnu general public license <<opt>>as published by the free software foundation either<<end>> version 3",
    "mit-notice": "<<opt>>released<<end>> <<opt>>licensed<<end>> under the mit license",
    "mit-text": (
        "<<opt>>mit license<<end>> <<opt>>copyright c <<var 16>><<end>> permission is hereby granted free of charge to any person "
        "obtaining a copy of this software and associated documentation files the software to deal in the software without "
        "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
        "copies of the software and to permit persons to whom the software is furnished to do so subject to the following "
        "conditions the above copyright notice and this permission notice <<opt>>including the next paragraph<<end>> shall be "
        "included in all copies or substantial portions of the software the software is provided as is without warranty of any kind "
        "express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
        "noninfringement in no event shall the <<opt>>authors or<<end>> copyright holders be liable for any claim damages or other "
        "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the "
        "use or other dealings in the software"
    ),
    "isc-text": (
        "permission to use copy modify and <<opt>>or<<end>> distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies the software is provided "
        "as is and <<var 8>> disclaims all warranties with regard to this software including all implied warranties of "
        "merchantability and fitness in no event shall <<var 8>> be liable for any special direct indirect or consequential damages "
        "or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other "
        "tortious action arising out of or in connection with the use or performance of this software"
    ),
    "bsd-2-clause-text": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met <<opt>>1<<end>> redistributions of source code must retain the above copyright notice this list of "
        "conditions and the following disclaimer <<opt>>2<<end>> redistributions in binary form must reproduce the above copyright "
        "notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the "
        "distribution this software is provided by <<var 12>> as is and any express or implied warranties including but not limited "
        "to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var 12>> "
        "be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to "
        "procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any "
        "theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of "
        "the use of this software even if advised of the possibility of such damage"
    ),
    "bsd-3-clause-text": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met <<opt>>1<<end>> redistributions of source code must retain the above copyright notice this list of "
        "conditions and the following disclaimer <<opt>>2<<end>> redistributions in binary form must reproduce the above copyright "
        "notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the "
        "distribution <<opt>>3<<end>> neither the name of <<var 12>> nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission this software is provided by "
        "<<var 12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability "
        "and fitness for a particular purpose are disclaimed in no event shall <<var 12>> be liable for any direct indirect incidental "
        "special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of "
        "use data or profits or business interruption however caused and on any theory of liability whether in contract strict "
        "liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the "
        "possibility of such damage"
    ),
    "zlib-text": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any "
        "damages arising from the use of this software permission is granted to anyone to use this software for any purpose including "
        "commercial applications and to alter it and redistribute it freely subject to the following restrictions <<opt>>1<<end>> the "
        "origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this "
        "software in a product an acknowledgment in the product documentation would be appreciated but is not required <<opt>>2<<end>> "
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "<<opt>>3<<end>> this notice may not be removed or altered from any source distribution"
    ),
    "apache-2.0-notice": (
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you "
        "may obtain a copy of the license at <<var 9>> unless required by applicable law or agreed to in writing software distributed "
        "under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see "
        "the license for the specific language governing permissions and limitations under the license"
    ),
    "gpl-2.0-or-later-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 2 of the license or at your option any later version this program is "
        "distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability "
        "or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of "
        "the gnu general public license along with this program"
    ),
    "gpl-3.0-or-later-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version this program is "
        "distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability "
        "or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of "
        "the gnu general public license along with this program"
    ),
    "lgpl-2.1-or-later-notice": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public "
        "license as published by the free software foundation either version 2.1 of the license or at your option any later version "
        "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu lesser general public license for more details you should "
        "have received a copy of the gnu lesser general public license along with this library"
    ),
    "mpl-2.0-notice": (
        "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed "
        "with this file you can obtain one at <<var 8>>"
    ),
}

#: Bytes that separate words become spaces, A-Z become a-z; bytes of non-ASCII characters belong to words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """A template as states: `step[s]` maps a word to the next state, `skip[s]` lists states reachable for free."""

    def __init__(self, template: str):
        self.step: list[dict[bytes, int]] = [{}]
        self.any: list[int | None] = [None]
        self.skip: list[list[int]] = [[]]
        runs: list[list[bytes]] = [[]]
        opened: list[int] = []
        for part in re.findall(r"<<[^>]*>>|[^<]+", template):
            if part == "<<opt>>":
                opened.append(len(self.step) - 1)
                runs.append([])
            elif part == "<<end>>":
                self.skip[opened.pop()].append(len(self.step) - 1)
                runs.append([])
            elif part.startswith("<<var"):
                first = len(self.step) - 1
                for _ in range(int(part[5:-2])):
                    s = len(self.step) - 1
                    self.any[s] = self._state()
                for s in range(first, len(self.step) - 1):
                    self.skip[s].append(len(self.step) - 1)
                runs.append([])
            else:
                for w in words_of(part):
                    s = len(self.step) - 1
                    self.step[s][w] = self._state()
                    if not opened:
                        runs[-1].append(w)
        self.final = len(self.step) - 1
        #: The longest mandatory run of words: no text without it is accepted.
        self.anchor = b" " + b" ".join(max(runs, key=len)) + b" "

    def _state(self) -> int:
        self.step.append({})
        self.any.append(None)
        self.skip.append([])
        return len(self.step) - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def accepts(self, words: list[bytes]) -> bool:
        """Whether the template stands somewhere in `words`. All starts are followed at once."""
        start = self._closed({0})
        states = set(start)
        for w in words:
            states = self._closed({t for s in states for t in (self.step[s].get(w), self.any[s]) if t is not None} | start)
            if self.final in states:
                return True
        return False


def scanner(base: dict[str, str], templates: dict[str, str]):
    """A function from a text to (words, base places, first, last, base labels, labels, score)."""
    automata = {label: Automaton(t) for label, t in templates.items()}
    phrases = [(b" " + b" ".join(words_of(p)) + b" ", label) for p, label in base.items()]

    def scan(text: str | None) -> tuple:
        words = words_of(text)
        line = b" " + b" ".join(words) + b" "
        places, found = [], set()
        for phrase, label in phrases:
            at = line.find(phrase)
            while at >= 0:
                places.append(at)
                found.add(label)
                at = line.find(phrase, at + 1)
        more = {label for label, a in automata.items() if a.anchor in line and a.accepts(words)}
        first = line.count(b" ", 0, min(places)) if places else None
        last = line.count(b" ", 0, max(places)) if places else None
        score = 1.0 if more else 0.5 if found else 0.0
        return len(words), len(places), first, last, ",".join(sorted(found)), ",".join(sorted(found | more)), score

    return scan


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, *, key: str = "doc_id", text: str = "text", base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Scan every whole text: (key, n_words, n_base, first_word, last_word, base_labels, labels, score).

    `score` is 1 where a template is accepted, 0.5 where only a base phrase stands, else 0. A null text counts as
    empty: no words, no labels (empty strings), null places. Null keys and repeated rows come back as they are, an
    empty table gives none; a long text is scanned as a whole; only the two named columns are read, whatever the names
    of others. One pass, no shuffle.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(base, templates)
        for b in by_few(batches):
            columns = list(zip(*map(scan, b.column(1).to_pylist()), strict=True)) if b.num_rows else [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["_key", *names])

    return rows.mapInArrow(run, f"_key {kind}, {SCHEMA}").withColumnRenamed("_key", key)


def _regex(template: str) -> str:
    """The template as a regular expression over words that are joined and framed by single spaces."""
    out = ""
    for part in re.findall(r"<<[^>]*>>|[^<]+", template):
        if part == "<<opt>>":
            out += "(?:"
        elif part == "<<end>>":
            out += ")?"
        elif part.startswith("<<var"):
            out += f"(?:[^ ]+ ){{0,{int(part[5:-2])}}}"
        else:
            out += "".join(re.escape(w.decode()) + " " for w in words_of(part))
    return f" {out}"


def oracle(table: str = "documents") -> str:
    """The scan in DuckDB SQL."""
    line = "' ' || array_to_string(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), ' ') || ' '"
    starts = " || ".join(
        f"list_transform(generate_series(1, len(string_split(line, ' {p} ')) - 1), lambda i: len(string_split(array_to_string(string_split(line, ' {p} ')[1:i], ' {p} '), ' ')) - 1)"
        for p in BASE
    )
    label = lambda name, test: f"CASE WHEN {test} THEN ['{name}'] ELSE [] END"
    base = " || ".join(label(v, f"contains(line, ' {k} ')") for k, v in BASE.items())
    more = " || ".join(label(k, f"regexp_matches(line, '{_regex(t)}')") for k, t in TEMPLATES.items())
    return f"""
        WITH a AS (SELECT doc_id, {line} AS line FROM {table}),
        b AS (SELECT *, {starts} AS places, {base} AS base, {more} AS more FROM a)
        SELECT doc_id, CAST(len(string_split(line, ' ')) - 2 + CASE WHEN line = '  ' THEN -1 ELSE 0 END AS BIGINT) AS n_words,
            CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
            array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
            array_to_string(list_sort(list_distinct(base || more)), ',') AS labels,
            CASE WHEN len(more) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
        FROM b"""
