"""License headers, grants and short notices; whole long licenses lie in ``license_texts``."""

from __future__ import annotations

_GNU = (
    "{it} is free software{semi} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by "
    "the Free Software Foundation; either version {version} of the License, or (at your option) any later version. "
)
_NO_WARRANTY = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."
)


def _gnu(kind: str, version: str) -> str:
    return (_GNU + _NO_WARRANTY).format(it="This program", semi=":", kind=kind, version=version)


_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
    "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
    "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_NO_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission. "
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
    "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
    "of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
    "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)

#: Grants and headers of the usual licenses.
HEADERS = {
    "MIT-text": _MIT,
    "BSD-2-Clause": _BSD + _AS_IS,
    "BSD-3-Clause": _BSD + _NO_NAMES + _AS_IS,
    "BSD-conditions": _BSD,
    "BSD-disclaimer": _AS_IS,
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions"
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"
    ),
    "Apache-2.0-limits": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
        "and limitations under the License."
    ),
    "GPL-2.0-header": _gnu("", "2"),
    "GPL-3.0-header": _gnu("", "3"),
    "LGPL-2.1-header": _gnu("Lesser ", "2.1"),
    "LGPL-3.0-header": _gnu("Lesser ", "3"),
    "AGPL-3.0-header": _gnu("Affero ", "3"),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "EPL-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/"
    ),
} | {
    f"CC-{code.upper().replace(' ', '-')}-4.0-deed": f"This work is licensed under the Creative Commons {name} 4.0 International License."
    for code, name in (
        ("by", "Attribution"), ("by sa", "Attribution-ShareAlike"), ("by nd", "Attribution-NoDerivatives"), ("by nc", "Attribution-NonCommercial"),
        ("by nc sa", "Attribution-NonCommercial-ShareAlike"), ("by nc nd", "Attribution-NonCommercial-NoDerivatives"),
    )
}

_NAMED = {
    "BSD-2-Clause-notice": ("the BSD 2-Clause License", "bsd 2 clause"),
    "BSD-3-Clause-notice": ("the BSD 3-Clause License", "bsd 3 clause"),
    "BSD-notice": ("the BSD License", "bsd license"),
    "ISC-notice": ("the ISC License", "isc license"),
    "MPL-2.0-notice": ("the Mozilla Public License, version 2.0", "mozilla public license"),
    "GPL-2.0-notice": ("the GNU General Public License, version 2", "gnu general public license version 2"),
    "LGPL-2.1-notice": ("the GNU Lesser General Public License, version 2.1", "gnu lesser general public license version 2 1"),
    "LGPL-3.0-notice": ("the GNU Lesser General Public License, version 3", "gnu lesser general public license version 3"),
    "AGPL-3.0-notice": ("the GNU Affero General Public License, version 3", "gnu affero general public license"),
    "EPL-2.0-notice": ("the Eclipse Public License, version 2.0", "eclipse public license"),
    "CC-BY-4.0-notice": ("CC BY 4.0", "cc by 4 0"),
    "CC-BY-SA-4.0-notice": ("CC BY-SA 4.0", "cc by sa"),
    "CC-BY-ND-4.0-notice": ("CC BY-ND 4.0", "cc by nd"),
    "CC-BY-NC-SA-4.0-notice": ("CC BY-NC-SA 4.0", "cc by nc sa"),
    "CC-BY-NC-ND-4.0-notice": ("CC BY-NC-ND 4.0", "cc by nc nd"),
}
#: Short notices.
SHORT = {name: f"Licensed under {what}." for name, (what, _) in _NAMED.items()}
#: Phrase that tells a short notice from its like; it must stand in the text unbroken.
NAMES = {name: phrase for name, (_, phrase) in _NAMED.items()} | {
    "MIT": "mit license",
    "Apache-2.0": "apache license",
    "GPL-3.0": "gnu general public license version 3",
    "CC-BY-NC-4.0": "cc by nc 4",
    "GPL-2.0-header": "gnu general public license",
    "GPL-3.0-header": "either version 3 of the license",
    "LGPL-2.1-header": "gnu lesser general public license",
    "LGPL-3.0-header": "gnu lesser general public license",
    "AGPL-3.0-header": "gnu affero general public license",
    "BSD-3-Clause": "may be used to endorse or promote products",
    "CC-BY-4.0-deed": "attribution 4 0",
    "CC-BY-SA-4.0-deed": "attribution sharealike",
    "CC-BY-ND-4.0-deed": "attribution noderivatives",
    "CC-BY-NC-4.0-deed": "attribution noncommercial 4 0",
    "CC-BY-NC-SA-4.0-deed": "attribution noncommercial sharealike",
    "CC-BY-NC-ND-4.0-deed": "attribution noncommercial noderivatives",
}
for _name, _phrase in (("GPL-2.0-header", "either version 2 of the license"), ("LGPL-2.1-header", "either version 2 1"), ("LGPL-3.0-header", "either version 3")):
    NAMES[_name] += "|" + _phrase
NAMES["GPL-3.0-header"] += "|gnu general public license"
