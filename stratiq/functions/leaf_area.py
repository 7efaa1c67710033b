"""Leaf area index from eight reflectances and three angles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import C, col
from .spectral import network, scaled, unscaled

# The published network of the Sentinel-2 biophysical processor.
# Ranges of the inputs, in the order of INPUTS; the azimuth is used as its cosine.
INPUTS = ("b03", "b04", "b05", "b06", "b07", "b8a", "b11", "b12", "view_zenith", "sun_zenith", "relative_azimuth")
RANGES = (
    (0.0, 0.253061520471542),
    (0.0, 0.290393577911328),
    (0.0, 0.305398915248555),
    (0.006637972542253, 0.608900395797889),
    (0.013972727018939, 0.753827384322927),
    (0.026690138082061, 0.782011770669178),
    (0.016388074192258, 0.493761397883092),
    (0.0, 0.493025984460231),
    (0.918595400582046, 1.0),
    (0.342022871159208, 0.936206429175402),
)
# Bias, then one weight per input, of each hidden neuron.
HIDDEN = [
    [4.96238030555279, -0.023406878966470, 0.921655164636366, 0.135576544080099, -1.938331472397950, -3.342495816122680, 0.902277648009576, 0.205363538258614, -0.040607844721716, -0.083196409727092, 0.260029270773809, 0.284761567218845],
    [1.416008443981500, -0.132555480856684, -0.139574837333540, -1.014606016898920, -1.330890038649270, 0.031730624503341, -1.433583541317050, -0.959637898574699, 1.133115706551000, 0.216603876541632, 0.410652303762839, 0.064760155543506],
    [1.075897047213310, 0.086015977724868, 0.616648776881434, 0.678003876446556, 0.141102398644968, -0.096682206883546, -1.128832638862200, 0.302189102741375, 0.434494937299725, -0.021903699490589, -0.228492476802263, -0.039460537589826],
    [1.533988264655420, -0.109366593670404, -0.071046262972729, 0.064582411478320, 2.906325236823160, -0.673873108979163, -3.838051868280840, 1.695979344531530, 0.046950296081713, -0.049709652688365, 0.021829545430994, 0.057483827104091],
    [3.024115930757230, -0.089939416159969, 0.175395483106147, -0.081847329172620, 2.219895367487790, 1.713873975136850, 0.713069186099534, 0.138970813499201, -0.060771761518025, 0.124263341255473, 0.210086140404351, -0.183878138700341],
]
OUTPUT = [1.096963107077220, -1.500135489728730, -0.096283269121503, -0.194935930577094, -0.352305895755591, 0.075107415847473]
OUTPUT_RANGE = (0.000319182538301, 14.4675094548151)


def leaf_area(reflectances: list[C], view_zenith: C, sun_zenith: C, relative_azimuth: C) -> Column:
    """A third of the network's output, as the published script scales it."""
    cosine = lambda x: F.cos(F.radians(col(x).cast("double")))
    values = [*map(col, reflectances), cosine(view_zenith), cosine(sun_zenith)]
    inputs = [scaled(x, *r) for x, r in zip(values, RANGES, strict=True)] + [cosine(relative_azimuth)]
    return unscaled(network(inputs, HIDDEN, OUTPUT), *OUTPUT_RANGE) / 3


def sql(values: list[str], relative_azimuth: str) -> str:
    """The same as SQL text, over SQL for the ten scaled inputs and for the azimuth's cosine."""
    inputs = [f"(({v}) - {low!r}e0) * 2e0 / ({high!r}e0 - {low!r}e0) - 1e0" for v, (low, high) in zip(values, RANGES, strict=True)] + [relative_azimuth]
    neuron = lambda row: " + ".join([f"{row[0]!r}e0", *(f"({w!r}e0) * ({x})" for w, x in zip(row[1:], inputs, strict=True))])
    hidden = [f"(2e0 / (1e0 + exp(-2e0 * ({neuron(row)}))) - 1e0)" for row in HIDDEN]
    out = " + ".join([f"{OUTPUT[0]!r}e0", *(f"({w!r}e0) * {h}" for w, h in zip(OUTPUT[1:], hidden, strict=True))])
    low, high = OUTPUT_RANGE
    return f"((({out}) + 1e0) * 0.5e0 * ({high!r}e0 - {low!r}e0) + {low!r}e0) / 3e0"
