"""License wordings as templates. The wordings are those of the licenses themselves.

``[[ ]]`` holds wording that may be left out; ``{{name: a|b c}}`` is replaced by one of the wordings given, and
``{{name: any 1-12}}`` by so many words of any kind. All else is mandatory, word for word.
"""

VERB = "{{verb: licensed|released|distributed|available|published|provided}}"
UNDER = f"{VERB} under [[the]] [[terms of]] [[the]] [[version {{{{number: 1|2|3}}}} of the]]"
HOLDER = "{{holder: any 1-12}}"
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
[[{{bullet: 1|a}}]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
[[{{bullet: 2|b}}]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
in the documentation and or other materials provided with the distribution"""
_BSD_NAMES = f"""[[{{{{bullet: 3|c}}}}]] neither the name of {HOLDER} nor the names of {{{{whose: its|their|any 1-6}}}} contributors may be used to endorse or promote products
derived from this software without specific prior written permission"""
_BSD_END = f"""this software is provided by {HOLDER} as is and any express or implied warranties including but not limited to the implied warranties of
merchantability and fitness for a particular purpose are disclaimed in no event shall {HOLDER} be liable for any direct indirect incidental special
exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business
interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in
any way out of the use of this software even if advised of the possibility of such damage"""
_ISC_END = f"""the software is provided as is and {HOLDER} disclaims all warranties with regard to this software including all implied warranties of
merchantability and fitness in no event shall {HOLDER} be liable for any special direct indirect or consequential damages or any damages whatsoever
resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with
the use or performance of this software"""
_GNU = "is free software you can redistribute it and or modify it under the terms of the gnu {kind} public license as published by the free software foundation [[either]] version {number} of the license [[or [[at your option]] any later version]]"

TEMPLATES: list[tuple[str, str]] = [
    ("mit", f"""permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to
deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright
notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software
the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
fitness for a particular purpose and noninfringement in no event shall {HOLDER} be liable for any claim damages or other liability
whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""),
    ("isc", f"permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies {_ISC_END}"),
    ("0bsd", f"permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted {_ISC_END}"),
    ("bsd-2-clause", f"{_BSD} {_BSD_END}"),
    ("bsd-3-clause", f"{_BSD} {_BSD_NAMES} {_BSD_END}"),
    ("apache-2.0", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy
of the license at [[{{scheme: http|https}}]] www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software
distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license
for the specific language governing permissions and limitations under the license"""),
    ("gpl-2.0", _GNU.format(kind="general", number="2")),
    ("gpl-3.0", _GNU.format(kind="general", number="3")),
    ("lgpl-2.1", _GNU.format(kind="lesser general", number="2 1")),
    ("lgpl-3.0", _GNU.format(kind="lesser general", number="3")),
    ("agpl-3.0", _GNU.format(kind="affero general", number="3")),
    ("mpl-2.0", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file
you can obtain one at [[{{scheme: http|https}}]] mozilla org mpl 2 0"""),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute
this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will {{holder: any 1-12}} be held liable for any damages arising
from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it
and redistribute it freely subject to the following restrictions"""),
    ("mit", f"{UNDER} mit license"),
    ("apache-2.0", f"{UNDER} apache license [[{{{{version: version|v}}}}]] 2 [[0]]"),
    ("gpl-2.0", f"{UNDER} [[gnu]] general public license [[{{{{version: version|v}}}}]] 2 [[0]]"),
    ("gpl-3.0", f"{UNDER} [[gnu]] general public license [[{{{{version: version|v}}}}]] 3 [[0]]"),
    ("lgpl-3.0", f"{UNDER} [[gnu]] lesser general public license [[{{{{version: version|v}}}}]] 3 [[0]]"),
    ("mpl-2.0", f"{UNDER} mozilla public license [[{{{{version: version|v}}}}]] 2 [[0]]"),
]
_TERMS = {"by": "{{by: by|attribution}}", "nc": "{{nc: nc|noncommercial|non commercial}}", "sa": "{{sa: sa|sharealike|share alike}}", "nd": "{{nd: nd|noderivatives|noderivs|no derivatives}}"}
for _kinds in ("by", "by-nc", "by-sa", "by-nd", "by-nc-sa", "by-nc-nd"):
    _said = " ".join(_TERMS[k] for k in _kinds.split("-"))
    TEMPLATES.append((f"cc-{_kinds}", f"{VERB} under [[{{{{article: a|the}}}}]] {{{{family: cc|creative commons}}}} {_said} {{{{end: license|1|2|3|4|international|any 0-1 license}}}} [[0]]"))
for _label, _said in {"mit": "mit", "apache-2.0": "apache 2 0", "bsd-2-clause": "bsd 2 clause", "bsd-3-clause": "bsd 3 clause", "isc": "isc", "mpl-2.0": "mpl 2 0", "gpl-2.0": "gpl 2 0", "gpl-3.0": "gpl 3 0", "lgpl-3.0": "lgpl 3 0"}.items():
    TEMPLATES.append((_label, f"spdx license identifier {_said} [[{{{{which: only|or later}}}}]]"))
