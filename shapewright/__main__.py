import sys

from shapewright.cli import main

sys.exit(main())
