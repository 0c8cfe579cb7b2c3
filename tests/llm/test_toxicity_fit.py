import numpy as np

from graphloom.llm import toxicity


def objective(w, b, lists, swapped, labels, weight, l2, fairness):
    """The loss as the docstring of fit has it, document by document."""
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    total = l2 * sum(x * x for x in w)
    moved = [k for k in range(len(lists)) if lists[k] != swapped[k]]
    for k, (x, y) in enumerate(zip(lists, labels, strict=True)):
        p = sigmoid(b + sum(w[f] for f in x))
        total -= weight[k] / sum(weight) * (y * np.log(p) + (1 - y) * np.log(1 - p))
        if k in moved:
            q = sigmoid(b + sum(w[f] for f in swapped[k]))
            total += fairness * weight[k] / sum(weight[m] for m in moved) * (p - q) ** 2
    return total


def test_the_fit_is_the_least_of_its_objective():
    rng = np.random.default_rng(6)
    size, n = 6, 60
    lists = [sorted(set(rng.integers(0, size, rng.integers(0, 4)).tolist())) for _ in range(n)]
    other = {0: 1, 1: 0}
    swapped = [sorted({other.get(f, f) for f in x}) for x in lists]
    labels = np.array([float(0 in x or rng.random() < 0.3) for x in lists])
    weight = rng.uniform(0.5, 2, n)
    for fairness in (0.0, 1.0, 10.0):
        b, w = toxicity.fit(lists, swapped, labels, weight, size, 0.01, fairness, steps=2000)
        at = np.append(w, b)
        value = lambda x: objective(x[:-1], x[-1], lists, swapped, labels, weight, 0.01, fairness)  # noqa: B023, E731
        slope = [(value(at + 1e-4 * e) - value(at - 1e-4 * e)) / 2e-4 for e in np.eye(size + 1)]
        assert np.abs(slope).max() < 2e-3
        # Coordinate descent from elsewhere comes to the same place.
        own, step = np.zeros(size + 1), 0.5
        while step > 1e-4:
            tries = [own + s * step * e for e in np.eye(size + 1) for s in (1, -1)]
            best = min(tries, key=value)
            own, step = (best, step) if value(best) < value(own) else (own, step / 2)
        assert abs(value(own) - value(at)) < 1e-4 and np.abs(own - at).max() < 0.05


def test_the_penalty_acts_on_the_registered_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fair, unfair = toxicity.train(docs, labels), toxicity.train(docs, labels, fairness=0.0)
    assert fair.swapped_rows > 0.5 * fair.rows and len(fair.swap) > 100
    terms = [t for t in fair.swap if unfair.weights.get(t)]
    gap = lambda m: np.mean([abs(m.score(f"{t} and so on") - m.score(f"{fair.swap[t]} and so on")) for t in terms])
    assert gap(fair) < 0.8 * gap(unfair)
    a, b = ({r.doc_id: r.score for r in toxicity.score(docs, m).collect()} for m in (fair, unfair))
    assert max(abs(a[i] - b[i]) for i in a) > 1e-6


def test_one_text_of_a_repeated_id_whatever_the_order(spark):
    rows = [(k, f"{'foul ' if k % 3 == 0 else ''}w{k % 7} word") for k in range(400)]
    rows += [(k, f"another text{k}") for k in range(0, 400, 5)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(400)], "doc_id long, toxic int")
    made = [toxicity.train(spark.createDataFrame(x, "doc_id long, text string").repartition(n), labels) for x, n in ((rows, 3), (rows[::-1], 7))]
    assert made[0].weights == made[1].weights and made[0].bias == made[1].bias
