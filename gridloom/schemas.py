"""Shapes of the tables that operators take and give.

Rasters are long: (image, y, x, v), one row a pixel. Polylines: (poly, i, x, y). Signals: (clip, t, s). Vectors:
(id, vec). Boxes: (id, x, y, w, h), touching edges don't intersect. Masks hold foreground where v exceeds a threshold.
"""

PIXELS = "image string, y int, x int, v double"
POINTS = "poly long, i int, x double, y double"
SAMPLES = "clip long, t long, s double"
BOXES = "id long, x double, y double, w double, h double"
#: The two thresholds in use: foreground is above.
FOREGROUND, FOREGROUND_STRICT = 127, 128
