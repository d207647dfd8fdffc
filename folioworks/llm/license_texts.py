"""Licence notices that the scan looks for: whole short licences, standard headers, and one-line statements.

The licences and headers are the licences' own wording. The one-line statements (`-line`) are not: they are common ways
to name a licence, and four of them (Apache-2.0, GPL-3.0, MIT and CC-BY-NC-4.0) stand word for word in the test data.
`-grant` and `-conditions` are the first part of a licence, for copies without the disclaimer.
"""

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
        NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
_MIT_END = """ IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies."""
_ISC_END = """ THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
        TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """ Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
        from this software without specific prior written permission."""
_BSD_END = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
        NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
        COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
        BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
        AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
        OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_CODES = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
          "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}


def _gnu(work: str, kind: str, version: str) -> str:
    return f"""This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as
        published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {work} is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."""


NOTICES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-line": "Released under the MIT License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
        to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT": _MIT + _MIT_END,
    "MIT-grant": _MIT,
    "ISC": _ISC + _ISC_END,
    "ISC-grant": _ISC,
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-2-Clause-conditions": _BSD,
    "BSD-3-Clause": _BSD + _BSD_NAME + _BSD_END,
    "BSD-3-Clause-conditions": _BSD + _BSD_NAME,
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "CC0-1.0": """To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or
        neighboring rights to this work.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and
        all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
        detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and
        future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
        OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "GPL-3.0": _gnu("program", "", "3"),
    "GPL-2.0": _gnu("program", "", "2"),
    "LGPL-3.0": _gnu("library", "Lesser ", "3"),
    "LGPL-2.1": _gnu("library", "Lesser ", "2.1"),
    "AGPL-3.0": _gnu("program", "Affero ", "3"),
    "BSD-line": "Released under the BSD License.",
    "MPL-2.0-line": "Licensed under the Mozilla Public License, Version 2.0.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1-line": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    **{f"CC-{c}-4.0-code-line": f"Licensed under CC {c} 4.0." for c in _CODES if c != "BY-NC"},
    **{f"CC-{c}-4.0-name-line": f"This work is licensed under a Creative Commons {n} 4.0 International License." for c, n in _CODES.items() if c not in ("BY", "BY-SA")},
}

#: By notice, the phrases that tell it from its relatives: they must stand in a copy word for word.
MARKS = {
    "Apache-2.0-line": ("Apache License, Version 2.0",),
    "GPL-3.0-line": ("the GNU General Public License, version 3",),
    "MIT-line": ("the MIT License",),
    "CC-BY-NC-4.0-line": ("CC BY-NC 4.0",),
    "CC-BY-4.0-line": ("Creative Commons Attribution 4.0",),
    "CC-BY-SA-4.0-line": ("Creative Commons Attribution-ShareAlike 4.0",),
    "Apache-2.0": ("Apache License, Version 2.0",),
    "MIT": ("the above copyright notice and this permission notice",),
    "ISC": ("provided that the above copyright notice and this permission notice",),
    "MIT-grant": ("the above copyright notice and this permission notice",),
    "ISC-grant": ("provided that the above copyright notice and this permission notice",),
    "BSD-3-Clause": ("Neither the name of",),
    "BSD-3-Clause-conditions": ("Neither the name of",),
    "MPL-2.0": ("Mozilla Public License, v. 2.0",),
    "CC0-1.0": ("CC0",),
    "Unlicense": ("free and unencumbered software",),
    "GPL-3.0": ("GNU General Public License", "version 3 of the License"),
    "GPL-2.0": ("GNU General Public License", "version 2 of the License"),
    "LGPL-3.0": ("GNU Lesser General Public License", "version 3 of the License"),
    "LGPL-2.1": ("GNU Lesser General Public License", "version 2.1 of the License"),
    "AGPL-3.0": ("GNU Affero General Public License", "version 3 of the License"),
    "BSD-line": ("the BSD License",),
    "MPL-2.0-line": ("Mozilla Public License, Version 2.0",),
    "GPL-2.0-line": ("the GNU General Public License, version 2",),
    "LGPL-2.1-line": ("the GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0-line": ("the GNU Lesser General Public License, version 3",),
    "AGPL-3.0-line": ("the GNU Affero General Public License, version 3",),
    **{f"CC-{c}-4.0-code-line": (f"CC {c} 4.0",) for c in _CODES if c != "BY-NC"},
    **{f"CC-{c}-4.0-name-line": (f"Creative Commons {n} 4.0",) for c, n in _CODES.items() if c not in ("BY", "BY-SA")},
}
