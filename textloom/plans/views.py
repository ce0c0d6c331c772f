"""Text derived from the tables, by SQL that Spark and DuckDB read alike.

The tables hold almost no wiki markup, so the markup queries build it from columns of `documents`.
"""

from __future__ import annotations

NL, Q = "chr(10)", "chr(39)"

#: One of everything that the extractors know, and look-alikes of their placeholders.
MARKUP = (
    f"concat(text, ' &lt;math&gt;', doc_id, '&lt;/math&gt; [http://', source, '.org ', lang, '] &lt;math&gt;x', n_chars, '&lt;/math&gt;"
    f" [[Image:', source, '.jpg|thumb]] [[image:', lang, '.png]]', {NL}, '{{|', {NL}, '|', source, {NL}, '|}}', {NL},"
    f" '<table><tr>', source, {NL}, '</table>', {NL}, '[[ja:', source, ']]', {NL}, '[[ko:', doc_id, ']] {{{{InfoBox ', source, '}}}} URL0_ MATH_1_ IMG3_ zz0_')"
)
#: Brackets, titles and quotes around words of the row.
WIKI = f"concat('The [[', source, ']] page.', {NL}, '== About ', lang, ' ==', {NL}, 'See {{{{main ', source, '}}}} or ', {Q}, {Q}, 'old', {Q}, {Q}, ' text [[a b]]c ', text)"
#: Escaped text, as a dump has it.
ESCAPED = "replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
#: A page of a dump; every fourth has an address for a contributor, some have restrictions or a comment.
PAGE = (
    f"concat({NL}, '  <page>', {NL}, '    <title>', source, ' ', doc_id, '</title>', {NL}, '    <id>', doc_id, '</id>', {NL},"
    f" CASE WHEN doc_id % 5 = 0 THEN concat('    <restrictions>move=', lang, '</restrictions>', {NL}) ELSE '' END,"
    f" '    <revision>', {NL}, '      <id>', n_chars, '</id>', {NL}, '      <timestamp>2006-03-04T05:06:07Z</timestamp>', {NL}, '      <contributor>', {NL},"
    f" CASE WHEN doc_id % 4 = 0 THEN concat('        <ip>10.0.0.', doc_id % 250, '</ip>', {NL}) ELSE concat('        <username>', source, '</username>', {NL}, '        <id>', doc_id + 7, '</id>', {NL}) END,"
    f" '      </contributor>', {NL}, CASE WHEN doc_id % 3 = 0 THEN concat('      <minor />', {NL}, '      <comment>', lang, '</comment>', {NL}) ELSE '' END,"
    f" '      <text xml:space=\"preserve\">', replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '</text>', {NL}, '    </revision>', {NL}, '  </page>')"
)
