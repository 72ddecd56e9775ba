"""Small tables of names: exclusion presets, file types, backup and preview extensions."""

# Names that scans leave out, by preset.
PRESET_DIRS = {
    "system": ("System Volume Information", "$SysReset", "Config.Msi", "Recovery"),
    "caches": (".cache", "Cache", "CachedData", ".thumbnails"),
    "build": ("node_modules", "__pycache__", ".venv", "venv", "build", "dist", "target", "vendor", ".gradle", ".tox", ".mypy_cache", ".pytest_cache"),
    "vcs": (".git", ".svn", ".hg"),
    "apps": (),
    "stubs": (),
    "trash": (".Trash", "$RECYCLE.BIN", "$Recycle.Bin", "$RECYCLER", "RECYCLER", "RECYCLED", ".Trashes"),
}
PRESET_PREFIXES = {
    "system": ("/proc", "/sys", "/dev", "/run", "/boot", "/usr", "/lib", "/lib64", "/sbin", "/bin"),
    "apps": ("/opt", "/var/lib/flatpak", "/snap"),
}
PRESET_GLOBS = {
    "stubs": ("*/.DS_Store", ".DS_Store", "*/Thumbs.db", "Thumbs.db", "*/desktop.ini", "desktop.ini"),
    "trash": ("*/.local/share/Trash/*", "*/.Trash-*/*"),
}

# Extensions by category and type.
FILE_TYPES = {
    "image": {"JPG": (".jpg", ".jpeg"), "PNG": (".png",), "HEIC": (".heic", ".heif"), "WEBP": (".webp",), "GIF": (".gif",), "TIFF": (".tiff", ".tif"), "BMP": (".bmp",), "RAW": (".raw", ".cr2", ".nef", ".arw", ".dng", ".orf", ".rw2"), "SVG": (".svg",)},
    "video": {"MP4": (".mp4", ".m4v"), "MOV": (".mov",), "MKV": (".mkv",), "AVI": (".avi",), "WEBM": (".webm",), "WMV": (".wmv",), "FLV": (".flv",), "MPG": (".mpg", ".mpeg"), "3GP": (".3gp",)},
    "music": {"MP3": (".mp3",), "FLAC": (".flac",), "WAV": (".wav",), "AAC": (".aac",), "M4A": (".m4a",), "OGG": (".ogg", ".oga"), "OPUS": (".opus",), "WMA": (".wma",), "AIFF": (".aiff", ".aif")},
    "document": {
        "PDF": (".pdf",), "Word": (".doc", ".docx", ".odt", ".ott", ".fodt", ".odm", ".rtf", ".sxw", ".stw"), "Spreadsheet": (".xls", ".xlsx", ".ods", ".ots", ".fods", ".csv", ".sxc", ".stc"), "Presentation": (".ppt", ".pptx", ".odp", ".otp", ".fodp", ".sxi", ".sti"),
        "Draw": (".odg", ".otg", ".fodg", ".sxd"), "Formula": (".odf", ".mml", ".sxm"), "Database": (".odb",), "Text": (".txt", ".md", ".rst", ".tex"), "EPUB": (".epub",),
    },
    "email": {"EML": (".eml",), "Outlook": (".msg", ".pst", ".ost"), "Mbox": (".mbox", ".mbx"), "Apple Mail": (".emlx",), "Express": (".dbx",), "Notes": (".nsf",)},
}
LARGE_TYPES = {"VDI": (".vdi",), "VMDK": (".vmdk",), "VHD": (".vhd", ".vhdx"), "QCOW2": (".qcow2", ".qcow"), "ISO": (".iso",), "IMG": (".img",), "BIN": (".bin",), "DMG": (".dmg",)}
#: Extensions that the image pass compares.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif", ".webp")

# Signs of a backup.
BACKUP_EXTENSIONS = (".bak", ".old", ".orig", ".save", ".swp", ".tmp", ".backup")
BACKUP_DIRS = ("backup", "backups", "snapshot", "snapshots", "old", "archive", "archives", "bak")

# Extensions by kind of preview, the first kind that names one wins.
PREVIEW_EXTENSIONS = {
    "image": (".jpg", ".jpeg", ".jfif", ".png", ".gif", ".bmp", ".tiff", ".tif", ".webp", ".svg", ".svgz", ".ico", ".xpm", ".pnm", ".ppm", ".pgm", ".pbm", ".tga", ".qoi", ".heic", ".heif", ".avif", ".jxl", ".cr2", ".cr3", ".nef", ".nrw", ".arw", ".srf", ".sr2", ".dng", ".orf", ".rw2", ".raf", ".pef", ".raw", ".rwl", ".x3f"),
    "video": (".mp4", ".m4v", ".mov", ".mkv", ".webm", ".avi", ".wmv", ".flv", ".mpg", ".mpeg", ".3gp", ".ogv"),
    "audio": (".mp3", ".flac", ".wav", ".wave", ".aac", ".m4a", ".m4b", ".ogg", ".oga", ".opus", ".wma", ".aiff", ".aif", ".aifc", ".alac", ".ape", ".wv", ".mka", ".mpc", ".ra"),
    "pdf": (".pdf",),
    "office": (".docx", ".odt", ".pptx", ".odp", ".xlsx", ".ods"),
    "archive": (".zip", ".jar", ".whl", ".tar", ".gz", ".tgz", ".bz2", ".xz", ".7z"),
    "text": (".txt", ".md", ".rst", ".log", ".csv", ".tsv", ".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".xml", ".html", ".css", ".js", ".ts", ".py", ".c", ".h", ".cpp", ".rs", ".go", ".java", ".sh", ".rb", ".php", ".sql"),
}

# Paths that actions refuse, besides the home folder.
PROTECTED = ("/", "/usr", "/etc", "/bin", "/boot", "/lib", "/proc", "/sys", "/dev", "/media", "/mnt", "/run", "/var")


def type_table(spark):
    """(category, type, ext) rows of the file types."""
    rows = [(c, t, e) for c, types in FILE_TYPES.items() for t, exts in types.items() for e in exts]
    return spark.createDataFrame(rows, "category string, type string, ext string")


def category_extensions(category: str) -> list[str]:
    """Sorted extensions of a category; an unknown one has none."""
    return sorted(e for exts in FILE_TYPES.get(category, {}).values() for e in exts)


def resolve_types(checked: dict[str, bool], custom: list[str]) -> list[str]:
    """Include filter from checked type labels: all checked or none means no filter."""
    labels = [(t, exts) for types in FILE_TYPES.values() for t, exts in types.items()]
    if all(checked.get(t, False) for t, _ in labels):
        return []
    return normalize_list([e for t, exts in labels if checked.get(t, False) for e in exts] + list(custom))


def normalize_list(exts) -> list[str]:
    """Trimmed, lower-case, dotted, distinct and sorted extensions."""
    cleaned = (e.strip().lower() for e in exts or ())
    return sorted({e if e.startswith(".") else f".{e}" for e in cleaned if e})
