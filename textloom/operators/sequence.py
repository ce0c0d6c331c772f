"""Sequence models: relational bigram statistics, and a small autodiff library for training on the driver or in a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.primitives import code_points
from textloom.operators.grams import Part, counted, parts, tally
from textloom.session import ship_package

#: Rows of a model that are broadcast at most.
MOST_BROADCAST = 200_000


def char_vocab(df: DataFrame, text: Column) -> DataFrame:
    """(code_point, n) of all characters."""
    return df.select(F.explode(code_points(text)).alias("c")).groupBy(F.ascii("c").alias("code_point")).agg(F.count("*").alias("n"))


def bigrams(df: DataFrame, text: Column) -> DataFrame:
    """(gram, n): how often a character follows another in a row."""
    return counted(df, text, (2,))


def row_bigrams(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, gram, k): the same for each row, in Arrow batches."""
    rows = df.select(id_col, text.alias("t")).where("length(t) > 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            part = Part(batch.column(1))
            pairs = part.base * part.base
            row = np.repeat(np.arange(batch.num_rows), part.marks + 1 - part.starts)[:-1]
            found, k = tally(row * pairs + part.codes[:-1] * part.base + part.codes[1:])
            codes = part.points(found % pairs, 2, [])
            whole = (codes > 0).all(1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found[whole] // pairs)), part.strings(codes[whole]), pa.array(k[whole], pa.int64())], [id_col, "gram", "k"])

    ship_package(df.sparkSession)
    return rows.mapInArrow(run, f"{id_col} {rows.dtypes[0][1]}, gram string, k long")


def perplexity(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, perplexity) of each row under the corpus' own character bigrams: 2 to the mean surprise in bits.

    Surprise is looked up once for each distinct pair of a row; the model has at most alphabet squared rows, and is
    broadcast if it has at most MOST_BROADCAST.
    """
    model = bigrams(df, text)
    model = model.withColumn("bits", -F.log2(F.col("n") / F.sum("n").over(Window.partitionBy(F.left("gram", F.lit(1)))))).select("gram", "bits")
    few = model.limit(MOST_BROADCAST + 1).toArrow()
    if few.num_rows <= MOST_BROADCAST:
        model = F.broadcast(df.sparkSession.createDataFrame(few))
    own = row_bigrams(df, id_col, text)
    return own.join(model, "gram").groupBy(id_col).agg(F.pow(F.lit(2.0), F.sum(F.col("k") * F.col("bits")) / F.sum("k")).alias("perplexity"))


def hmm_fit(df: DataFrame, text: Column) -> DataFrame:
    """(kind, from_state, to, n, p): initial, transition and emission shares of a first-order model whose states are letter, digit and each symbol.

    A character has one state, so that all counts are sums of those of characters, of pairs and of first characters.
    """
    state = lambda c: F.when(c.rlike(r"(?s)^\p{L}$"), "letter").when(c.rlike(r"(?s)^\p{Nd}$"), "digit").otherwise(c)
    one = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("from_state"), b.alias("to"))
    first, last = F.left("gram", F.lit(1)), F.right("gram", F.lit(1))
    begun = df.select(F.left(text, F.lit(1)).alias("gram")).where("gram <> ''").groupBy("gram").agg(F.count("*").alias("n")).select(one("initial", F.lit(""), state(first)).alias("x"), "n")
    shown = counted(df, text, (1, 2)).select(F.when(F.length("gram") == 1, one("emission", state(first), first)).otherwise(one("transition", state(first), state(last))).alias("x"), "n")
    summed = begun.unionAll(shown).groupBy("x.kind", "x.from_state", "x.to").agg(F.sum("n").alias("n"))
    return summed.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("kind", "from_state")))


def likely_substrings(df: DataFrame, text: Column, longest: int = 5, most: int = 30) -> DataFrame:
    """(sub, log_likelihood): distinct substrings of 1 to `longest` characters, likeliest first under hmm_fit(df, text); at most `most` rows."""
    model = hmm_fit(df, text).select("kind", "from_state", "to", F.log("p").alias("lp")).persist()  # asked three times
    try:
        shown = model.where("kind = 'emission'").select(F.col("to").alias("c"), F.col("from_state").alias("s"), F.col("lp").alias("emit"))
        begun = model.where("kind = 'initial'").select(F.col("to").alias("s"), F.col("lp").alias("begin"))
        moved = model.where("kind = 'transition'").select(F.col("from_state").alias("before"), F.col("to").alias("s"), F.col("lp").alias("move"))
        subs = counted(df, text, range(1, longest + 1), "sub").select("sub")
        letters = subs.select("sub", F.posexplode(code_points(F.col("sub"))).alias("at", "c")).join(shown, "c")
        letters = letters.withColumn("before", F.lag("s").over(Window.partitionBy("sub").orderBy("at")))
        scored = letters.join(begun, "s", "left").join(moved, ["before", "s"], "left")
        step = F.col("emit") + F.when(F.col("at") == 0, F.col("begin")).otherwise(F.col("move"))
        total = scored.groupBy("sub").agg(F.sum(step).alias("log_likelihood"), F.count(step).alias("known"), F.count("*").alias("size")).where("known = size")
        best = total.select("sub", "log_likelihood").orderBy(F.desc("log_likelihood"), "sub").limit(most)
        return df.sparkSession.createDataFrame(best.collect(), "sub string, log_likelihood double")
    finally:
        model.unpersist()


def text_steps(lines: Sequence[str]) -> tuple[list[str], list[list[tuple[np.ndarray, np.ndarray]]]]:
    """(alphabet, sequences) of one-hot steps; index 0 is the start and the end of a line, a step's target is the next character."""
    alphabet = ["", *dict.fromkeys(c for line in lines for c in line)]
    hot = np.eye(len(alphabet))
    number = {c: i for i, c in enumerate(alphabet)}
    codes = [[0, *(number[c] for c in line), 0] for line in lines]
    return alphabet, [[(hot[a], hot[b]) for a, b in zip(code, code[1:])] for code in codes]  # noqa: B905


def generate(model: Network, alphabet: Sequence[str], rng: np.random.Generator, temperature: float = 1.0, longest: int = 200, words: set[str] | None = None) -> str:
    """A line of text: sampled, or by arg-max at temperature 0; with words, only prefixes of those are continued."""
    model.reset()
    at, out = 0, ""
    for _ in range(longest):
        logits = model(np.eye(len(alphabet))[at]).value
        if words is not None:
            open_word = out.rpartition(" ")[2]
            fits = [any(w.startswith(open_word + c) for w in words) if c not in ("", " ") else open_word in words for c in alphabet]
            logits = np.where(fits, logits, -np.inf)
            if not any(fits):
                break
        if temperature == 0:
            at = int(logits.argmax())
        else:
            e = np.exp((logits - logits.max()) / temperature)
            at = int(rng.choice(len(alphabet), p=e / e.sum()))
        if at == 0:
            break
        out += alphabet[at]
    return out


def parity(spark, sequences: int, length: int, seed: int = 42) -> DataFrame:  # noqa: ANN001
    """(seq_id, step, bit, target): target is the parity of the bits so far."""
    steps = spark.range(sequences).select(F.col("id").alias("seq_id"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("step"))
    bits = steps.withColumn("bit", F.pmod(F.xxhash64(F.lit(seed), "seq_id", "step"), F.lit(2)).cast("int"))
    return bits.withColumn("target", (F.sum("bit").over(Window.partitionBy("seq_id").orderBy("step")) % 2).cast("int"))


REBER = {0: (("T", 1), ("P", 2)), 1: (("S", 1), ("X", 3)), 2: (("T", 2), ("V", 4)), 3: (("X", 2), ("S", 5)), 4: (("P", 3), ("V", 5))}


def embedded_reber(rng: np.random.Generator) -> str:
    """A word of the embedded Reber grammar."""
    outer, inner, at = "TP"[rng.integers(2)], "", 0
    while at != 5:
        letter, at = REBER[at][rng.integers(2)]
        inner += letter
    return f"B{outer}B{inner}E{outer}E"


class Node:
    """A matrix with its gradient; backward() replays the operations in reverse order."""

    def __init__(self, value: np.ndarray, parents: Sequence[Node] = (), pull: Callable[[np.ndarray], Sequence[np.ndarray]] | None = None):
        self.value, self.grad, self.parents, self.pull = np.asarray(value, float), np.zeros(np.shape(value)), parents, pull

    def backward(self, seed: np.ndarray | float = 1.0) -> None:
        order, seen = [], set()

        def visit(node: Node) -> None:
            if id(node) not in seen:
                seen.add(id(node))
                for p in node.parents:
                    visit(p)
                order.append(node)

        visit(self)
        self.grad = self.grad + seed
        for node in reversed(order):
            if node.pull:
                for p, g in zip(node.parents, node.pull(node.grad), strict=True):
                    p.grad = p.grad + g

    def __add__(self, other: Node) -> Node:
        return Node(self.value + other.value, (self, other), lambda g: (g, g))

    def __sub__(self, other: Node) -> Node:
        return Node(self.value - other.value, (self, other), lambda g: (g, -g))

    def __neg__(self) -> Node:
        return Node(-self.value, (self,), lambda g: (-g,))

    def __mul__(self, other: Node) -> Node:
        return Node(self.value * other.value, (self, other), lambda g: (g * other.value, g * self.value))

    def __matmul__(self, other: Node) -> Node:
        return Node(self.value @ other.value, (self, other), lambda g: (np.outer(g, other.value) if other.value.ndim == 1 else g @ other.value.T, self.value.T @ g))

    def one_minus(self) -> Node:
        return Node(1 - self.value, (self,), lambda g: (-g,))

    def scaled(self, by: float) -> Node:
        return Node(self.value * by, (self,), lambda g: (g * by,))


def concat(a: Node, b: Node) -> Node:
    return Node(np.concatenate((a.value, b.value)), (a, b), lambda g: (g[: len(a.value)], g[len(a.value) :]))


UNITS: dict[str, tuple[Callable[[np.ndarray], np.ndarray], Callable[[np.ndarray, np.ndarray], np.ndarray]]] = {
    "sigmoid": (lambda x: 1 / (1 + np.exp(-x)), lambda x, y: y * (1 - y)),
    "tanh": (np.tanh, lambda x, y: 1 - y * y),
    "sine": (np.sin, lambda x, y: np.cos(x)),
    "relu": (lambda x: np.where(x >= 0, x, 0.01 * x), lambda x, y: np.where(x >= 0, 1.0, 0.01)),
    "linear": (lambda x: x, lambda x, y: np.ones_like(x)),
}


def unit(name: str, x: Node) -> Node:
    apply, slope = UNITS[name]
    y = apply(x.value)
    return Node(y, (x,), lambda g: (g * slope(x.value, y),))


class Layer:
    """Parameters by name; the call takes an input and gives an output, state kept between calls of one sequence."""

    def __init__(self, rng: np.random.Generator, spread: float = 0.08, **shapes: tuple[int, ...]):
        self.weights = {k: Node(rng.normal(0, spread, s) if len(s) > 1 else np.zeros(s)) for k, s in shapes.items()}

    def reset(self) -> None:
        """Forget the sequence."""


class FeedForward(Layer):
    def __init__(self, inputs: int, outputs: int, kind: str, rng: np.random.Generator):
        super().__init__(rng, w=(outputs, inputs), b=(outputs,))
        self.kind = kind

    def __call__(self, x: Node) -> Node:
        return unit(self.kind, self.weights["w"] @ x + self.weights["b"])


class Rnn(Layer):
    def __init__(self, inputs: int, outputs: int, kind: str, rng: np.random.Generator):
        super().__init__(rng, w=(outputs, inputs + outputs), b=(outputs,))
        self.kind, self.size = kind, outputs
        self.reset()

    def reset(self) -> None:
        self.state = Node(np.zeros(self.size))

    def __call__(self, x: Node) -> Node:
        self.state = unit(self.kind, self.weights["w"] @ concat(x, self.state) + self.weights["b"])
        return self.state


class Gru(Layer):
    def __init__(self, inputs: int, outputs: int, rng: np.random.Generator):
        super().__init__(rng, **{f"w{g}": (outputs, inputs + outputs) for g in "mrc"}, **{f"b{g}": (outputs,) for g in "mrc"})
        self.size = outputs
        self.reset()

    def reset(self) -> None:
        self.state = Node(np.zeros(self.size))

    def __call__(self, x: Node) -> Node:
        w = self.weights
        joined = concat(x, self.state)
        keep, use = unit("sigmoid", w["wm"] @ joined + w["bm"]), unit("sigmoid", w["wr"] @ joined + w["br"])
        fresh = unit("tanh", w["wc"] @ concat(x, use * self.state) + w["bc"])
        self.state = keep * self.state + keep.one_minus() * fresh
        return self.state


class Lstm(Layer):
    def __init__(self, inputs: int, outputs: int, rng: np.random.Generator):
        super().__init__(rng, **{f"w{g}": (outputs, inputs + outputs) for g in "ifoc"}, **{f"b{g}": (outputs,) for g in "ifoc"})
        self.weights["bf"].value[:] = 1.0
        self.size = outputs
        self.reset()

    def reset(self) -> None:
        self.state, self.cell = Node(np.zeros(self.size)), Node(np.zeros(self.size))

    def __call__(self, x: Node) -> Node:
        w, joined = self.weights, concat(x, self.state)
        gate = {g: unit("sigmoid", w[f"w{g}"] @ joined + w[f"b{g}"]) for g in "ifo"}
        self.cell = gate["f"] * self.cell + gate["i"] * unit("tanh", w["wc"] @ joined + w["bc"])
        self.state = gate["o"] * unit("tanh", self.cell)
        return self.state


class Network:
    def __init__(self, layers: Sequence[Layer]):
        self.layers = list(layers)

    def __call__(self, x: np.ndarray) -> Node:
        out = Node(x)
        for layer in self.layers:
            out = layer(out)
        return out

    def reset(self) -> None:
        for layer in self.layers:
            layer.reset()

    def parameters(self) -> list[Node]:
        return [w for layer in self.layers for w in layer.weights.values()]


def network(kind: str, inputs: int, hidden: int, layers: int, outputs: int, rng: np.random.Generator, bottleneck: int = 0, last: str = "linear") -> Network:
    """A stack of `kind` (lstm, gru, rnn, feed_forward) layers, a linear bottleneck before them if asked for."""
    stack: list[Layer] = []
    if bottleneck:
        stack.append(FeedForward(inputs, bottleneck, "linear", rng))
        inputs = bottleneck
    make = {"lstm": lambda a, b: Lstm(a, b, rng), "gru": lambda a, b: Gru(a, b, rng), "rnn": lambda a, b: Rnn(a, b, "tanh", rng), "feed_forward": lambda a, b: FeedForward(a, b, "tanh", rng)}[kind]
    for _ in range(layers):
        stack.append(make(inputs, hidden))
        inputs = hidden
    return Network([*stack, FeedForward(inputs, outputs, last, rng)])


def softmax_loss(out: np.ndarray, target: np.ndarray, temperature: float = 1.0) -> tuple[float, np.ndarray]:
    """(cross-entropy, gradient)."""
    e = np.exp(out / temperature - (out / temperature).max())
    p = e / e.sum()
    return float(-np.log(max(p[int(target.argmax())], 1e-300))), p - target


def squares_loss(out: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray]:
    return float(((out - target) ** 2).sum() / 2), out - target


def argmax_error(out: np.ndarray, target: np.ndarray) -> float:
    return float(out.argmax() != target.argmax())


def binary_error(out: np.ndarray, target: np.ndarray) -> float:
    return float(((out >= 0.5) != (target >= 0.5)).any())


def median_perplexity(losses: Sequence[Sequence[float]]) -> float:
    """Median over sequences of 2 to the mean surprise in bits, one step short."""
    return float(np.median([2 ** (sum(x / np.log(2) for x in steps) / max(1, len(steps) - 1)) for steps in losses]))


class Trainer:
    """RMSProp after every sequence, with clipped gradients and weight decay; stops when nothing is left to learn."""

    def __init__(self, model: Network, loss=softmax_loss, rate: float = 0.005, decay: float = 0.999, clip: float = 5.0, l2: float = 1e-6):  # noqa: ANN001
        self.model, self.loss, self.rate, self.decay, self.clip, self.l2 = model, loss, rate, decay, clip, l2
        self.cache = [np.zeros_like(p.value) for p in model.parameters()]

    def run(self, sequences: Sequence[Sequence[tuple[np.ndarray, np.ndarray | None]]], learn: bool = True) -> float:
        """Mean loss of the steps that have a target."""
        total, steps = 0.0, 0
        for sequence in sequences:
            self.model.reset()
            outs = []
            for x, target in sequence:
                out = self.model(x)
                if target is not None:
                    value, grad = self.loss(out.value, target)
                    if not np.isfinite(value):
                        raise FloatingPointError("the loss is not finite")
                    total, steps = total + value, steps + 1
                    outs.append((out, grad))
            if learn and outs:
                whole = outs[0][0] * Node(outs[0][1])
                for out, grad in outs[1:]:
                    whole = concat(whole, out * Node(grad))
                whole.backward(np.ones_like(whole.value))
                for p, c in zip(self.model.parameters(), self.cache, strict=True):
                    g = np.clip(p.grad, -self.clip, self.clip)
                    c *= self.decay
                    c += (1 - self.decay) * g * g
                    p.value = p.value - self.rate * g / np.sqrt(c + 1e-8) - self.l2 * p.value
                    p.grad = np.zeros_like(p.value)
        return total / max(1, steps)
