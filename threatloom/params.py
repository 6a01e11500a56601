"""One immutable bag of thresholds and toggles, passed to every operator."""

from __future__ import annotations

from dataclasses import dataclass

from threatloom.functions import constants as K


@dataclass(frozen=True)
class Params:
    """Defaults are the documented ones; override with ``Params(spam_threshold=3.0)``.

    A limit of None is no limit; those that only protect a single process are None by default.
    """

    spam_threshold: float = 5.0
    check_headers: bool = True
    check_urls: bool = True

    nlp_threshold: float = 0.7
    check_social: bool = True
    check_urgency: bool = True
    check_authority: bool = True
    check_psychological: bool = False

    check_attachments: bool = True
    small_video_check: bool = True
    media_medium: float = 2.0
    media_high: float = 5.0

    threat_low: float = 30.0

    max_per_folder: int = 50
    max_attachment_count: int = 10
    max_attachment_bytes: int = 25 * K.MIB
    max_total_attachment_bytes: int = 100 * K.MIB
    max_body_chars: int | None = None
    max_parts: int | None = None
    max_archive_members: int | None = None
    max_subject_chars: int | None = None
    max_model_chars: int | None = None
    check_interval_seconds: int = 300
    sample_size: int = 1000
    product_name: str = "threatloom"

    @property
    def max_message_bytes(self) -> int:
        """Largest message accepted by the size guard."""
        if self.max_total_attachment_bytes > 0:
            return self.max_total_attachment_bytes + K.MESSAGE_OVERHEAD_BYTES
        return K.UNLIMITED_MESSAGE_BYTES


DEFAULTS = Params()
