"""Public license texts and notices as template markup, with their labels. Fixed wording.

`<<opt>> ... <<end>>` may be left out, `<<any N>>` stands for at most N words. Case and punctuation
do not matter. A text that differs in one mandatory word is not accepted.
"""

from __future__ import annotations

#: What BSD texts say after their conditions.
_BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY <<any 10>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL <<any 10>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN
IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE
"""
_BSD_CONDITIONS = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
<<opt>>1.<<end>> Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer.
<<opt>>2.<<end>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
<<opt>>3.<<end>> Neither the name of <<any 12>> nor the names of <<opt>>its<<end>> <<opt>>any<<end>> contributors
may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_MIT_GRANT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so
"""
_MIT_DISCLAIMER = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE
"""


def _gnu(name: str, version: str) -> str:
    """The notice that GNU licenses ask for at the head of a file."""
    return f"""
free software<<opt>>;<<end>> you can redistribute it and/or modify it under the terms of the {name} as published by
the Free Software Foundation, <<opt>>either<<end>> version {version} of the License<<opt>>, or (at your option) any
later version<<end>>.
<<any 8>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.
<<opt>>You should have received a copy of the {name} along with <<any 4>><<opt>>; if not, write to the Free Software
Foundation<<end>><<opt>> If not, see <<any 6>><<end>><<end>>
"""


#: Whole texts and notices.
TEXTS = (
    (f"<<opt>>MIT License <<opt>>(MIT)<<end>><<end>> <<opt>>Copyright <<any 16>> <<opt>>All rights reserved<<end>><<end>> {_MIT_GRANT} subject to the following conditions: The above copyright notice and this permission notice <<opt>>(including the next paragraph)<<end>> shall be included in all copies or substantial portions of the Software. {_MIT_DISCLAIMER}", "mit"),
    (f"{_MIT_GRANT}. {_MIT_DISCLAIMER}", "mit-0"),
    (f"{_BSD_CONDITIONS} {_BSD_DISCLAIMER}", "bsd-2-clause"),
    (f"{_BSD_CONDITIONS} {_BSD_NAMES} {_BSD_DISCLAIMER}", "bsd-3-clause"),
    (
        """Permission to use, copy, modify, and<<opt>>/or<<end>> distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
        "AS IS" AND <<any 8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<any 8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
        OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE""",
        "isc",
    ),
    (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at <<any 10>> Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License""",
        "apache-2",
    ),
    (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at <<any 6>> MPL 2.0""",
        "mpl-2",
    ),
    (
        """provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<opt>>1.<<end>>
        The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
        this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        <<opt>>2.<<end>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
        software. <<opt>>3.<<end>> This notice may not be removed or altered from any source distribution""",
        "zlib",
    ),
    (
        f"""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial
        or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software
        dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of
        the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
        relinquishment in perpetuity of all present and future rights to this software under copyright law. {_MIT_DISCLAIMER.replace("AUTHORS OR", "AUTHORS").replace("COPYRIGHT HOLDERS", "")}""",
        "unlicense",
    ),
    (_gnu("GNU General Public License", "2"), "gpl-2"),
    (_gnu("GNU General Public License", "3"), "gpl-3"),
    (_gnu("GNU Lesser General Public License", "<<any 2>>"), "lgpl"),
    (_gnu("GNU Affero General Public License", "3"), "agpl-3"),
)

#: Short statements that name a license rather than give its text.
STATEMENTS = (
    ("<<opt>>released<<end>> <<opt>>licensed<<end>> under the terms of the MIT license", "mit"),
    ("licensed under the Apache License, Version 2.0", "apache-2"),
    ("licensed under the GNU General Public License <<opt>>as published by the Free Software Foundation<<end>>, <<opt>>either<<end>> version 2", "gpl-2"),
    ("licensed under the GNU General Public License <<opt>>as published by the Free Software Foundation<<end>>, <<opt>>either<<end>> version 3", "gpl-3"),
    ("licensed under the GNU Lesser General Public License <<opt>>as published by the Free Software Foundation<<end>>, <<opt>>either<<end>> version <<any 2>>", "lgpl"),
    ("subject to the terms of the Mozilla Public License, <<opt>>version<<end>> <<opt>>v<<end>> 2.0", "mpl-2"),
    ("licensed under <<opt>>a<<end>> <<opt>>the<<end>> Creative Commons Attribution 4.0 <<opt>>International<<end>> <<opt>>Public<<end>> License", "cc-by"),
    ("licensed under <<opt>>a<<end>> <<opt>>the<<end>> Creative Commons Attribution-ShareAlike 4.0 <<opt>>International<<end>> <<opt>>Public<<end>> License", "cc-by-sa"),
    ("licensed under <<opt>>a<<end>> <<opt>>the<<end>> Creative Commons Attribution-NonCommercial 4.0 <<opt>>International<<end>> <<opt>>Public<<end>> License", "cc-by-nc"),
    ("licensed under CC BY 4.0", "cc-by"),
    ("licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("SPDX-License-Identifier: MIT", "mit"),
    ("SPDX-License-Identifier: Apache-2.0", "apache-2"),
    ("SPDX-License-Identifier: BSD-2-Clause", "bsd-2-clause"),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
    ("SPDX-License-Identifier: ISC", "isc"),
    ("SPDX-License-Identifier: MPL-2.0", "mpl-2"),
    ("SPDX-License-Identifier: GPL-2.0", "gpl-2"),
    ("SPDX-License-Identifier: GPL-3.0", "gpl-3"),
)

TEMPLATES = TEXTS + STATEMENTS
