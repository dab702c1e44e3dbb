"""What can go wrong, as exceptions."""


class IndexFault(Exception):
    """Base of all faults of the engine."""


class NotFound(IndexFault):
    """No index at that place."""


class AlreadyExists(IndexFault):
    """An index is there already."""


class InvalidVector(IndexFault):
    """A row that cannot be stored or searched for; ``position`` is its place among the rows given."""

    def __init__(self, position: int, why: str = ""):
        super().__init__(f"vector at position {position} is invalid" + (f": {why}" if why else ""))
        self.position = position


class InvalidTraining(IndexFault):
    """Too few, too many or unusable training rows."""


class InvalidOptions(IndexFault):
    """Search or build options that contradict each other or the index."""


class EmptyCommit(IndexFault):
    """A commit without rows."""


class RowLimit(IndexFault):
    """More rows than row ids."""


class SegmentLimit(IndexFault):
    """More segments than a manifest holds."""


class Corrupt(IndexFault):
    """Stored data that is not what was written."""


class IdentityMismatch(IndexFault):
    """Parts that belong to different indexes or models."""


class CertificateInvalid(IndexFault):
    """Bounds that contradict each other or the present error budget."""


class Unsupported(IndexFault):
    """A stored version that this code does not know."""


class Busy(IndexFault):
    """Another builder is publishing just now."""


class Conflict(IndexFault):
    """Another builder has published since this one began; begin again from what is there now."""


class CommitOutcomeUnknown(IndexFault):
    """The pointer may or may not have been moved to ``generation``."""

    def __init__(self, generation: int):
        super().__init__(f"generation {generation} may or may not be published")
        self.generation = generation
