"""The phrases of the base rule, and the notices of public licences with
the phrases that must stand in a copy. Words are ASCII letters and digits; everything
between them is a separator, so punctuation here doesn't count."""

from __future__ import annotations

from typing import NamedTuple


class Template(NamedTuple):
    label: str
    notice: str
    key_phrases: tuple[str, ...]


BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

TEMPLATES = (
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3.",
             ("gnu general public license", "version 3")),
    Template("gpl-2", "This work is licensed under the GNU General Public License, version 2.",
             ("gnu general public license", "version 2")),
    Template("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
             "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
             ("gnu general public license", "free software foundation", "version 3")),
    Template("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
             "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
             ("gnu general public license", "free software foundation", "version 2")),
    Template("lgpl-3", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
             "Public License as published by the Free Software Foundation; either version 3 of the License, or any later version.",
             ("gnu lesser general public license", "version 3")),
    Template("agpl-3", "This work is licensed under the GNU Affero General Public License, version 3.",
             ("gnu affero general public license", "version 3")),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files (the Software), to deal in the Software without restriction, including without limitation the rights "
             "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
             ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    Template("mit", "Released under the MIT License.", ("mit license",)),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
             "with the License. You may obtain a copy of the License at", ("apache license version 2 0", "in compliance with the license")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
             "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
             "conditions and the following disclaimer.",
             ("redistribution and use in source and binary forms", "retain the above copyright notice")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
             "granted, provided that the above copyright notice and this permission notice appear in all copies.",
             ("for any purpose with or without fee is hereby granted",)),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license v 2 0",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain.",
             ("free and unencumbered software", "into the public domain")),
    Template("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held "
             "liable for any damages arising from the use of this software.", ("in no event will the authors be held liable",)),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
             ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
             ("creative commons attribution sharealike",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
             ("creative commons attribution 4 0",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
             ("waived all copyright and related or neighboring rights",)),
)
