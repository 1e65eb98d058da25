"""Names of copies, folders, targets, patterns and sizes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from heronry.functions.constants import COPY_SUFFIXES, IGNORED_ENDINGS, IGNORED_NAMES, IMAGE_EXTENSIONS, VIDEO_EXTENSIONS


def copy_suffix(stem: Column) -> Column:
    """Number of the first pattern of COPY_SUFFIXES that the stem ends with, 0 if none."""
    out = F.lit(0)
    for i in range(len(COPY_SUFFIXES), 0, -1):
        out = F.when(stem.rlike("(?i)" + COPY_SUFFIXES[i - 1]), i).otherwise(out)
    return out


def base_of_copy(stem: Column) -> Column:
    """The stem without the suffix a copy got; one suffix, of the first pattern that matches."""
    out = stem
    for p in reversed(COPY_SUFFIXES):
        out = F.when(stem.rlike("(?i)" + p), F.regexp_replace(stem, "(?i)" + p, "")).otherwise(out)
    return out


def file_type(ext: Column) -> Column:
    """image, video or other, of an extension with its dot in any case."""
    e = F.lower(ext)
    return F.when(e.isin(IMAGE_EXTENSIONS), "image").when(e.isin(VIDEO_EXTENSIONS), "video").otherwise("other")


def folder_key(ts: Column) -> Column:
    """2024/March"""
    return F.date_format(ts, "yyyy/MMMM")


def category_folder(scheme: str, ts: Column, label: Column) -> Column:
    """yyyy_mm_category, category_yyyy_mm or flat_tags."""
    y, m = F.date_format(ts, "yyyy"), F.date_format(ts, "MM")
    if scheme == "yyyy_mm_category":
        return F.concat_ws("/", y, m, label)
    if scheme == "category_yyyy_mm":
        return F.concat_ws("/", label, y, m)
    return label


def remote_path(path: Column, root: str, flat: bool = False, prefix: str = "") -> Column:
    """Mirror of the path below root, or the name alone, below a prefix at the destination if there is one."""
    name = F.element_at(F.split(path, "/"), -1)
    inside = F.startswith(path, F.lit(root.rstrip("/") + "/"))
    below = name if flat else F.when(inside, F.substr(path, F.lit(len(root.rstrip("/")) + 2))).otherwise(name)
    return F.concat(F.lit(prefix.strip("/") + "/"), below) if prefix.strip("/") else below


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = pattern[i + 1:end]
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}(?!.)"  # Java's $ would also match before a final line break


def ignored(name: Column, patterns: list[str] = ()) -> Column:
    """Whether a watcher passes a file name over: hidden, unfinished, system files, or one of the patterns."""
    out = F.startswith(name, F.lit(".")) | name.isin(IGNORED_NAMES)
    for e in IGNORED_ENDINGS:
        out = out | F.endswith(name, F.lit(e))
    for p in patterns:
        out = out | name.rlike(glob_regex(p))
    return out


def inside(path: Column, root: str) -> Column:
    """The root itself or a path below it."""
    r = root.rstrip("/")
    return (path == r) | F.startswith(path, F.lit(r + "/"))


def trash_name(path: Column, stamp: Column) -> Column:
    """stamp_path__with__underscores"""
    return F.concat_ws("_", stamp, F.replace(F.ltrim(path, F.lit("/")), F.lit("/"), F.lit("__")))


def human_size(n: Column, units: tuple[str, ...] = ("B", "KB", "MB", "GB", "TB")) -> Column:
    """1536 as 1.50 KB; the last unit is open-ended."""
    out = F.format_string(f"%.2f {units[-1]}", n / float(1024 ** (len(units) - 1)))
    for i in range(len(units) - 2, -1, -1):
        out = F.when(n < 1024 ** (i + 1), F.format_string(f"%.2f {units[i]}", n / float(1024 ** i))).otherwise(out)
    return out


# Types by extension.
MIME = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".bmp": "image/bmp", ".heic": "image/heic",
        ".webp": "image/webp", ".tiff": "image/tiff", ".raf": "image/x-fuji-raf", ".mp4": "video/mp4", ".mov": "video/quicktime", ".avi": "video/x-msvideo",
        ".mkv": "video/x-matroska", ".webm": "video/webm", ".wmv": "video/x-ms-wmv", ".flv": "video/x-flv"}


def mime_type(ext: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(ext)), F.lit("application/octet-stream"))
