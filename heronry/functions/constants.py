"""Constants whose values are part of the results."""

IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".heic", ".bmp", ".tiff", ".gif", ".raf"]
VIDEO_EXTENSIONS = [".mp4", ".mov", ".avi", ".mkv", ".wmv", ".flv", ".webm"]
SYNC_EXTENSIONS = IMAGE_EXTENSIONS + VIDEO_EXTENSIONS + [".webp", ".tif", ".cr2", ".nef", ".arw"]

# Hamming distances by name
THRESHOLDS = {"exact": 0, "very_similar": 5, "similar": 10, "loose": 15}

# key, label, priority, default_enabled, detection
TAXONOMY = [
    ("videos", "Videos", 0, True, "filesystem"),
    ("documents", "Documents", 1, True, "heuristic"),
    ("screenshots", "Screenshots", 1, True, "heuristic"),
    ("people", "People", 2, True, "ml_face"),
    ("travel", "Travel", 2, True, "exif+ml"),
    ("family", "Family", 3, True, "face+scene"),
    ("selfies", "Selfies", 3, False, "face_bbox"),
    ("events", "Events", 3, True, "face+exif"),
    ("nature", "Nature / Scenery", 4, True, "ml_scene"),
    ("food", "Food", 4, False, "ml_scene"),
    ("pets", "Pets / Animals", 4, False, "ml_scene"),
    ("vehicles", "Vehicles", 5, False, "ml_scene"),
    ("art", "Art / Architecture", 5, False, "ml_scene"),
    ("night", "Night / Landscape", 5, False, "exif+ml"),
    ("other", "Other / Unclassified", 99, True, "fallback"),
]

# Landscape sizes; each also counts upright.
SCREEN_SIZES = [
    (1920, 1080), (2560, 1440), (3840, 2160), (1366, 768), (1440, 900), (1680, 1050), (1280, 720), (1280, 800), (1600, 900), (2560, 1600),
    (3440, 1440), (2560, 1080), (2880, 1800), (3024, 1964), (2048, 1536), (5120, 2880),
    (1334, 750), (2436, 1125), (2532, 1170), (2556, 1179), (2778, 1284), (2796, 1290), (1792, 828), (2688, 1242),
    (2400, 1080), (2340, 1080), (3200, 1440), (3120, 1440), (2732, 2048), (2360, 1640), (2388, 1668),
]
SCREENSHOT_SOFTWARE = ["screenshot", "snip", "capture", "screen", "grabber", "sharex", "lightshot", "greenshot"]
DOCUMENT_RATIOS = [1.4142, 1.2941, 1.5455]

TRAVEL_KEYWORDS = [
    "travel", "vacation", "holiday", "trip", "airport", "flight", "beach", "resort", "hotel", "motel", "hostel", "tourism", "landmark",
    "monument", "sightseeing", "cruise", "backpacking", "abroad", "international", "passport", "hiking", "camping", "temple", "cathedral",
    "museum", "national park",
]
EVENT_KEYWORDS = [
    "birthday", "wedding", "party", "celebration", "anniversary", "graduation", "ceremony", "festival", "concert", "reunion", "christmas",
    "new year", "thanksgiving", "easter", "halloween", "baby shower", "engagement", "reception", "prom", "gala",
]

# Scene classes by category as inclusive ranges. Later categories take over a class from earlier ones.
SCENE_CLASSES = [
    ("nature", [(331, 332), (846, 850), (970, 976), (979, 980)]),
    ("food", [(504, 504), (567, 567), (809, 809), (899, 899), (924, 969)]),
    ("pets", [(0, 24), (30, 69), (151, 268), (281, 285)]),
    ("vehicles", [(404, 404), (407, 407), (436, 436), (468, 468), (510, 511), (555, 555), (569, 569), (573, 575), (609, 609), (627, 628), (654, 654),
                  (656, 656), (665, 665), (670, 670), (675, 675), (705, 705), (717, 717), (724, 724), (734, 734), (751, 751), (779, 779), (814, 814),
                  (817, 817), (864, 864), (867, 867), (874, 874), (895, 895)]),
    ("art", [(483, 483), (497, 497), (536, 536), (538, 541), (556, 556), (575, 577), (663, 663), (668, 669), (698, 698), (725, 728), (730, 730),
             (732, 732), (743, 743), (797, 797), (831, 836), (838, 838)]),
    ("travel", [(405, 405), (449, 449), (694, 694)]),
]

FACE_THRESHOLDS = {"strict": 0.7, "balanced": 0.6, "loose": 0.5}
# level: JPEG quality, video CRF
COMPRESSION_LEVELS = {1: (95, 18), 2: (85, 23), 3: (75, 28)}
EVENT_STATUSES = ["stabilized", "enqueued", "running", "completed", "failed"]
SUPPRESSING_STATUSES = ["completed", "ignored", "failed"]
BATCH_GAP_SECONDS = 3
PENDING_SECONDS = 300
IGNORED_ENDINGS = [".tmp", ".part", ".crdownload"]
IGNORED_NAMES = [".DS_Store", "Thumbs.db"]

# Ordered; the first that matches a stem, in any case, is cut off.
COPY_SUFFIXES = [
    r"\s*\((\d+)\)$",
    r"\s*\(copy\)$",
    r"\s*-\s*Copy(\d*)$",
    r"\s+copy(\d*)$",
    r"[-_]copy(\d*)$",
    r"[-_](\d+)$",
    r"\s+(\d+)$",
]
