"""Small networks with known results."""

from culvert.schema import NODES, PIPES


def node(network, ord_, id_, kind, invert, rim, area=0.0, c=0.0, tc=None, x=0.0, y=0.0):
    return (network, ord_, id_, kind, float(invert), float(rim), float(area), float(c), (0.0 if kind == "outfall" else 10.0) if tc is None else float(tc), float(x), float(y))


def pipe(network, ord_, id_, a, b, length, size, n=0.013, shape=None, rise=None, span=None):
    return (network, ord_, id_, a, b, float(length), float(size), n, shape, rise, span)


def frames(spark, nodes, pipes):
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(pipes, PIPES)


def demo(network=1):
    nodes = [
        node(network, 1, "N1", "inlet", 104, 110, 1, 0.7, 12, 0), node(network, 2, "N2", "inlet", 102.5, 108.5, 1, 0.7, 10, 300),
        node(network, 3, "N3", "junction", 101.2, 107, 0.5, 0.8, 8, 550), node(network, 4, "OUT", "outfall", 100, 106, x=730),
    ]
    pipes = [pipe(network, 1, "P1", "N1", "N2", 300, 1.25), pipe(network, 2, "P2", "N2", "N3", 250, 1.5), pipe(network, 3, "P3", "N3", "OUT", 180, 1.75)]
    return nodes, pipes


def one(invert_up, rim_up, invert_dn, rim_dn, length, size, area, c, network=1, **kw):
    """A single reach."""
    return [node(network, 1, "N1", "inlet", invert_up, rim_up, area, c), node(network, 2, "OUT", "outfall", invert_dn, rim_dn)], [pipe(network, 1, "P1", "N1", "OUT", length, size, **kw)]


def two(inverts, rims, loads, lengths, sizes, network=1, kinds=("inlet", "inlet"), places=((0, 0), (0, 0), (0, 0))):
    nodes = [node(network, k + 1, i, kind, inverts[k], rims[k], *loads[k], x=places[k][0], y=places[k][1]) for k, (i, kind) in enumerate(zip(("N1", "N2"), kinds, strict=True))]
    nodes.append(node(network, 3, "OUT", "outfall", inverts[2], rims[2], x=places[2][0], y=places[2][1]))
    return nodes, [pipe(network, 1, "P1", "N1", "N2", lengths[0], sizes[0]), pipe(network, 2, "P2", "N2", "OUT", lengths[1], sizes[1])]
