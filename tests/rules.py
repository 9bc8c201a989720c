"""Plain-Python statement of the scoring rule, written from the
specification, used as the test oracle for both Spark forms."""

NOT_IN_GOLD = "Not in Gold Label"


def score_dialogue(answers, labels, reasons=None, exact=False):
    """answers: list of parsed answers in order; labels: [(symptom, weight)]
    of the dialogue's disease in file order."""
    reasons = reasons or [""] * len(answers)
    gold_list = "".join("-" + s + "\n" for s, _ in labels).strip()
    score, weighted, penalty, reward = 0, 0, 0.0, 0.0
    trace, why, seen_labels = "", "", []
    poisoned = False
    for ans, reason in zip(answers, reasons):
        if ans in gold_list:
            score += 1
            weights = [w for s, w in labels if s == ans]
            if not weights:
                poisoned = True
                break
            weighted += 2 if weights[0] == "h" else 1
            seen = (ans in seen_labels) if exact else (ans in trace)
            penalty += 0.5 if seen else 1.0
            reward += 1.5 if seen else 1.0
            label = ans
        else:
            label = NOT_IN_GOLD
        seen_labels.append(label)
        why += "- " + reason + "\n"
        trace += "- " + label + "\n"
    if poisoned:
        score = weighted = -1
    return score, weighted, penalty, reward, trace, why
